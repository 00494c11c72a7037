"""Operators that compare texts, and those with files, against brute force
and exact round trips."""

from __future__ import annotations

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tasklane.llm import (components, decontaminate, html_blocks,
                          html_extract, range_coder, simhash, token_output,
                          tokens)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _print(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c
                             for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in (
        [w[i:i + 4] for i in range(len(w) - 3)] or [w])]
    return sum(1 << b for b in range(64)
               if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(prints, radius):
    """Component number of each print, by comparing all."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(list("abcdefghij"), 80)) for _ in range(12)]
    texts = [None, "", " \n", "One", "one", "one two three", "É x é y z",
             "word " * 60_000, *base]
    for t in base:
        w = t.split()
        for k in range(3):
            w[10 * k] = "ZZ"
            texts.append(" ".join(w))
    ids = [None, *(1000 - 7 * i for i in range(1, len(texts)))]
    texts.append(texts[9])
    ids.append(ids[9])
    df = spark.createDataFrame(list(zip(ids, texts)),
                               "doc_id long, text string"
                               ).withColumn("fp", F.lit("clash"))
    got = simhash.simhash_near_dedup(df, radius=8).collect()
    prints = [_print(t) for t in texts]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted(
        (str(i), f"{p:016x}") for i, p in zip(ids, prints))
    cls = _classes(prints, 8)
    least = {}
    for c, i in zip(cls, ids):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    assert len(set(cls)) < len(texts) - 6
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got
                  ) == sorted((str(i), str(least.get(c)))
                              for c, i in zip(cls, ids))
    kept = simhash.near_dedup(df, radius=8)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(least.get(c)) for c in set(cls))
    assert simhash.simhash_near_dedup(df.where("false")).count() == 0
    assert simhash.near_dedup(df.where("false")).count() == 0
    alone = simhash.simhash_near_dedup(df.where("doc_id is null")).first()
    assert alone.component_id is None


@pytest.mark.parametrize("parts,tile", [(1, 8), (2, 16), (4, 4096), (8, 2)])
def test_tiles_lose_no_link(spark, parts, tile):
    rng = np.random.default_rng(11)
    seeds = rng.integers(0, 2 ** 63, 60, dtype=np.uint64) * np.uint64(2)
    prints = set(seeds.tolist()) | {0, 2 ** 64 - 1, 15, 31}
    for s in seeds[:30].tolist():
        for _ in range(6):
            for b in rng.choice(64, 4, replace=False):
                s ^= 1 << int(b)
            prints.add(s)
    prints = sorted(prints)
    df = spark.createDataFrame(
        [(int(np.array(p, np.uint64).view(np.int64)),) for p in prints],
        "fp long")
    found = simhash.links(df, 4, parts, tile).collect()
    edges = {(r.a & (2 ** 64 - 1), r.b & (2 ** 64 - 1)) for r in found}
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    cls = _classes(prints, 4)
    assert [prints[c] for c in cls] == [find(p) for p in prints]


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    extra = [(3, 3), (2, 1), (1, 2), (None, 4), (-5, -9)]
    df = spark.createDataFrame(chain + star + extra, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = {i: 1 for i in range(2, 201)} | {5000 + i: 5000 for i in
                                            range(1, 300)} | {-5: -9}
    assert {n: r for n, r in got.items() if n != r} == want
    assert components.components(df.where("false")).count() == 0


def _sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1),
                          h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_matches_the_full_matrix():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 20)) for _ in range(2))
        score, end = decontaminate.align(a, b)
        assert score == _sw(a, b)
        if score:
            assert _sw(a, b[:end]) == score


def test_decontamination_finds_edited_copies(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(300)] + ["É" * 3]
    items = [" ".join(rng.choice(vocab, 30)) for _ in range(12)]
    filler = [" ".join(rng.choice(vocab, 200)) for _ in range(20)]
    edited = items[1].upper().split()
    edited[7] = "changed"
    del edited[15]
    edited.insert(22, "more, words;")
    docs = [(0, f"{filler[0]}\n{items[0]}\n{filler[1]}"),
            (1, f"{filler[2]} {'! '.join(edited)} {filler[3]}"),
            (2, f"{items[2]} {items[3]}"), (3, None), (4, ""),
            (5, " ".join(items[4].split()[:12])),
            (6, " ".join(filler) * 30 + items[5]), (None, items[6]),
            *[(100 + i, f) for i, f in enumerate(filler)],
            (0, f"{filler[0]}\n{items[0]}\n{filler[1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn(
        "hits_", F.lit(1))
    bench = spark.createDataFrame(
        [*enumerate(items), (0, items[0]), (50, None), (51, ""), (52, "w1"),
         (None, items[7])], "item_id long, text string")
    got = decontaminate.benchmark_hits(df, bench, ["doc_id"]).collect()
    hits = {str(r.doc_id): sorted(h.item_id for h in r.hits) for r in got}
    assert len(got) == len(docs)
    assert {k: v for k, v in hits.items() if v} == {
        "0": [0], "1": [1], "2": [2, 3], "6": [5], "None": [6]}
    one = next(r for r in got if r.doc_id == 0).hits[0]
    assert (one.score, one.start, one.end) == (1.0, 200, 230)
    clean = decontaminate.decontaminated(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == len(docs) - 6
    # in blocks of a few items, the same
    small = list(decontaminate.item_blocks(bench, 100))
    assert len(small) > 3 and sum(map(len, small)) == len(items) + 3
    again = decontaminate.benchmark_hits(df, bench, ["doc_id"],
                                         block_words=100).collect()
    assert sorted((str(r.doc_id), sorted(r.hits)) for r in again) == sorted(
        (str(r.doc_id), sorted(r.hits)) for r in got)
    assert decontaminate.benchmark_hits(df, bench.where("false")).where(
        "size(hits) > 0").count() == 0
    assert decontaminate.benchmark_hits(df.where("false"), bench).count() == 0


@pytest.mark.parametrize("edit", ["replace", "insert", "delete"])
@pytest.mark.parametrize("every", [4, 5, 6])
def test_decontamination_finds_copies_edited_throughout(spark, edit, every):
    rng = np.random.default_rng(13)
    vocab = [f"w{i}" for i in range(3000)]
    items = [rng.choice(vocab, 36).tolist() for _ in range(4)]

    def copy(item):
        out = []
        for k, w in enumerate(item, 1):
            if k % every:
                out.append(w)
            elif edit != "delete":
                out += [w, "new"] if edit == "insert" else ["new"]
        return out
    # Many equal copies and a verbatim one don't hide one another.
    docs = [(k, " ".join([*rng.choice(vocab, 50), *copy(items[k % 4]),
                          *rng.choice(vocab, 50)])) for k in range(40)]
    docs += [(100, " ".join(items[0])),
             *[(200 + k, " ".join(rng.choice(vocab, 136)))
               for k in range(10)]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(k, " ".join(w)) for k, w in enumerate(items)],
        "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in
           decontaminate.benchmark_hits(df, bench).collect()}
    assert got == {k: [k % 4] for k in range(40)} | {100: [0]} | {
        200 + k: [] for k in range(10)}


def test_common_words_cost_no_alignment(monkeypatch):
    """Long ordinary texts and many items of the same words: two seeds near
    one diagonal are rare."""
    rng = np.random.default_rng(15)
    vocab = np.array([f"w{i}" for i in range(400)])
    share = 1 / np.arange(1, 401)
    share /= share.sum()

    def text(n):
        return " ".join(rng.choice(vocab, n, p=share))
    items = decontaminate.prepare_items([(k, text(40)) for k in range(2000)])
    words, ptr = decontaminate._words(pa.array([text(3000)]))
    done, own = [], decontaminate.align
    monkeypatch.setattr(decontaminate, "align",
                        lambda *a: done.append(1) or own(*a))
    known = decontaminate.Lookup(items.seeds)
    hits = list(decontaminate._hits(items, known, words, ptr, 3, 0.5, 13))
    grams, _ = decontaminate._grams(words, ptr, 3)
    assert not hits and len(known.find(grams)[0]) > 500
    assert len(done) < 200


def test_every_pair_that_aligns_with_its_seeds_is_found():
    """Against the alignment of all texts with all items, whole."""
    rng = np.random.default_rng(16)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(rng.choice(vocab, int(rng.integers(3, 30)))))
            for k in range(40)]
    texts = []
    for k in range(160):
        part = [w for w in rows[k % 40][1].split() if rng.random() > 0.15]
        texts.append(" ".join([*rng.choice(vocab, 15), *part,
                               *rng.choice(vocab, 15)]))
    items = decontaminate.prepare_items(rows)
    words, ptr = decontaminate._words(pa.array(texts))
    got = {(i, j): s for i, j, s, _, _ in decontaminate._hits(
        items, decontaminate.Lookup(items.seeds), words, ptr, 3, 0.5, 13)}
    seen = 0
    for i in range(len(texts)):
        text = words[ptr[i]:ptr[i + 1]]
        for j in range(len(rows)):
            own = items.words[items.ptr[j]:items.ptr[j + 1]]
            score, end = decontaminate.align(own, text)
            if (i, j) in got:
                assert got[i, j] <= score / (2 * len(own)) + 1e-9
                continue
            if score < len(own):
                continue
            back = decontaminate.align(own[::-1], text[:end][::-1])[1]
            places = {}
            for a in range(end - back, end - 2):
                for o in range(len(own) - 2):
                    if (text[a:a + 3] == own[o:o + 3]).all():
                        places.setdefault(o, a)
            needed = 1 if len(own) < decontaminate.LONE_WORDS else max(
                2, len(own) // decontaminate.WORDS_PER_SEED)
            assert len(set(places.values())) < needed, (i, j)
        seen += (i, i % 40) in got
    assert seen > 100


def test_decontamination_finds_parts_of_long_items(spark):
    rng = np.random.default_rng(14)
    vocab = [f"w{i}" for i in range(3000)]
    items = [rng.choice(vocab, n).tolist() for n in (59, 400, 2000)]

    def edited(words, every):
        return [w if k % every else "new" for k, w in enumerate(words, 1)]
    parts = [(items[0][20:49], 0), (items[2][600:1500], 2),
             (edited(items[1][100:160], 6), 1),
             (edited(items[2][:150], 5), 2), (items[1][50:63], 1),
             (items[1][50:62], None), (edited(items[1][100:160], 3), None)]
    docs = [(k, " ".join([*rng.choice(vocab, 80), "before", *p, "after",
                          *rng.choice(vocab, 80)]))
            for k, (p, _) in enumerate(parts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(k, " ".join(w)) for k, w in enumerate(items)],
        "item_id long, text string")
    got = {r.doc_id: r.hits for r in
           decontaminate.benchmark_hits(df, bench).collect()}
    assert {k: [h.item_id for h in v] for k, v in got.items()} == {
        k: [] if j is None else [j] for k, (_, j) in enumerate(parts)}
    assert (got[0][0].start, got[0][0].end) == (81, 110)
    assert got[1][0].score == 900 / 2000


def _words(rng, n):
    return " ".join(rng.choice([f"x{i}" for i in range(5000)], n))


def test_pages_without_an_article_lose_what_the_host_repeats(spark):
    rng = np.random.default_rng(8)
    top, shared = _words(rng, 12), _words(rng, 20)
    rows, want = [], {}
    for i in range(20):
        body = _words(rng, 30)
        more = f"<div>{shared}</div>" if i < 2 else ""
        rows.append((i, f"http://h.com/{i}", f"<div>{top}</div><p>{body}</p>"
                     f"{more}<p>{top} tail{i}</p>"))
        want[i] = "\n".join([body, *([shared] if i < 2 else []), f"tail{i}"])
    rows += [(50, "http://h.com/z", None), (51, None, ""),
             (52, "http://o.com/", f"<p>{top}</p>")]
    want |= {50: "", 51: "", 52: top}
    df = spark.createDataFrame(rows, "page_id long, url string, html string"
                               ).withColumn("part", F.lit("clash"))
    got = html_extract.html_extract(df).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.html_extract(df.where("false")).count() == 0


def _brute_host(pages):
    """Texts of one host's pages without article markup, each page a list of
    blocks of words: runs counted by dictionaries, blocks cut by regular
    steps."""
    distinct = list(dict.fromkeys(tuple(map(tuple, p)) for p in pages))
    seen = {}
    for k, p in enumerate(distinct):
        s = [w for b in p for w in b]
        for i in range(len(s) - 7):
            seen.setdefault(tuple(s[i:i + 8]), set()).add(k)
    need = max(3, min(10, -(-3 * len(distinct) // 10)))
    out = []
    for p in pages:
        s = [w for b in p for w in b]
        hit = [False] * len(s)
        for i in range(len(s) - 7):
            if len(distinct) >= 3 and len(seen[tuple(s[i:i + 8])]) >= need:
                hit[i:i + 8] = [True] * 8
        lines, at = [], 0
        for b in p:
            own, at = hit[at:at + len(b)], at + len(b)
            words = list(zip(b, own, strict=True))
            if sum(own) >= 0.8 * len(b):
                while words and words[0][1]:
                    words.pop(0)
                while words and words[-1][1]:
                    words.pop()
            if words:
                lines.append(" ".join(w for w, _ in words))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_a_whole_host_matches_brute_force(spark, seed):
    """Menus, footers with a unique end, shared sentences at the start, in
    the middle and at the end of paragraphs, copies of pages."""
    rng = np.random.default_rng(seed)
    chrome = [_words(rng, n).split() for n in (3, 9, 14, 25)]
    shared = [_words(rng, n).split() for n in (8, 15, 15)]
    n = (7, 45, 90, 160)[seed]
    pages = []
    for i in range(n):
        blocks = [chrome[k] for k in rng.permutation(4)[:rng.integers(0, 4)]]
        for _ in range(rng.integers(0, 4)):
            own = _words(rng, rng.integers(1, 40)).split()
            at = rng.integers(0, len(own) + 1)
            blocks.append(own[:at] + shared[rng.integers(3)] + own[at:]
                          if rng.random() < 0.5 else own)
        blocks.append(chrome[2] + [f"tail{i}"] if i % 3 else chrome[2])
        pages.append(pages[i - 1] if i % 11 == 10 else blocks)
    df = spark.createDataFrame(
        [(i, f"http://h.com/{i}", "".join(f"<p>{' '.join(b)}</p>" for b in p))
         for i, p in enumerate(pages)], "page_id long, url string, html string")
    want = dict(enumerate(_brute_host(pages)))
    for size in (16, 1000):
        got = html_extract.html_extract(df, group_pages=size).collect()
        assert {r.page_id: r.text for r in got} == want


def test_shared_sentences_stay_in_their_paragraphs(spark):
    rng = np.random.default_rng(12)
    sentence, banner = _words(rng, 15), _words(rng, 12)
    rows, want = [], {}
    for i in range(400):
        a, b = _words(rng, 20), _words(rng, 25)
        body = (f"{a} {sentence} {b}" if i % 30 == 0 else f"{a} {b}")
        more = f"<div>{banner}</div>" if i % 10 == 0 else ""
        rows.append((i, "http://big.com/", f"{more}<p>{body}</p>"))
        want[i] = body
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.html_extract(df).collect()
    assert {r.page_id: r.text for r in got} == want
    assert {r.n_removed for r in got} == {0, 12}


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(3)
    for top in (5, 300, 1 << 22, 1 << 40):
        x = np.unique(rng.integers(0, top, 1000))
        assert (html_extract.unpack(html_extract.pack(x)) == x).all()
    assert not len(html_extract.unpack(html_extract.pack(np.zeros(0, int))))


def test_runs_count_over_the_whole_host(spark):
    rng = np.random.default_rng(10)
    section, few, note = (_words(rng, n) for n in (14, 15, 16))
    rows, want = [], {}
    for i in range(300):
        body = _words(rng, 20)
        more = section if i % 20 == 0 else few if i % 50 == 1 else ""
        url, text = f"http://h.com/{i}", [body, more] if more == few else [
            body]
        if i < 20:      # an article, its note outside of others' articles
            rows.append((i, url, f"<article><p>{body}</p><p>{note}</p>"
                         f"</article><footer>{note}</footer>"))
            text = [body]
        else:
            rows.append((i, url, f"<p>{body}</p><p>{more}</p>"))
        want[i] = "\n".join(text)
    # Copies of a page count once, whatever group they are in.
    copied = _words(rng, 25)
    rows += [(1000 + i, f"http://h.com/c{i}", f"<p>{copied}</p>")
             for i in range(40)]
    want |= {1000 + i: copied for i in range(40)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (4, 64, 1000):
        got = html_extract.html_extract(df, group_pages=size).collect()
        assert {r.page_id: r.text for r in got} == want
    # A large host of few distinct pages is like a small one.
    same = spark.createDataFrame(
        [(i, f"http://h.com/{i}", f"<p>{note}</p><p>{few if i % 2 else body}"
          f"</p>") for i in range(60)],
        "page_id long, url string, html string")
    for size in (8, 1000):
        assert all(r.n_removed == 0 for r in html_extract.html_extract(
            same, group_pages=size).collect())


def test_articles_keep_what_they_share(spark):
    rng = np.random.default_rng(9)
    shared, note = _words(rng, 60), _words(rng, 15)
    rows = [(i, "https://a.org/x", f"<nav>{_words(rng, 9)}</nav><article><h1>"
             f"T{i}</h1><p>{shared}</p><p>{note}</p></article><footer>{note}"
             "</footer>") for i in range(12)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.html_extract(df, group_pages=1000).collect()
    assert len(got) == 13
    assert all(r.text == f"T{r.page_id}\n{shared}" for r in got)


def _covered(streams, run, need):
    """Brute force: tokens in a window that enough streams hold."""
    seen = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            seen.setdefault(tuple(s[i:i + run]), set()).add(k)
    return [[any(len(seen[tuple(s[a:a + run])]) >= need
                 for a in range(max(0, i - run + 1),
                                min(i, len(s) - run) + 1))
             for i in range(len(s))] for s in streams]


def test_suffix_classes_match_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(30):
        streams = [rng.integers(0, 3, rng.integers(1, 40)).tolist()
                   for _ in range(5)]
        page = np.repeat(np.arange(5), [len(s) for s in streams])
        flat = np.concatenate(streams)
        rank = html_extract.suffix_classes(flat, page, 4)
        key = np.unique(rank * 5 + page)
        often = np.bincount(key // 5, minlength=rank.max() + 1) >= 2
        got = html_extract._cover(often[rank], 4, len(flat))
        assert got.tolist() == [x for s in _covered(streams, 4, 2)
                                for x in s]


@pytest.mark.parametrize("page,want", [
    ("<p>a<b>b<p>c", [(1, "ab"), (1, "c")]),
    ("<article><header><h1>T</h1></header><p>x&amp;&nbsp;y<br>z</p>"
     "<section class='comments'><p>no</p></section></article><p>rest",
     [(0, "T"), (0, "x& y z"), (2, "no"), (1, "rest")]),
    ("<div class='ad'>x</div><div class=\"has-sidebar\">y</div>",
     [(2, "x"), (1, "y")]),
    ("<script>if (a < b) '<p>'</script><style>p{}</style><p>t",
     [(1, "t")]),
    ("<!-- <p>x</p> --><p title='a > b' data-x=it's>ok</p><!-- open <p>no",
     [(1, "ok")]),
    ("<main>m<form>f</form></main><p>r", [(0, "m"), (2, "f"), (1, "r")]),
    ("1 < 2 and 3 > 2 <p", [(1, "1 < 2 and 3 > 2")]),
    ("<ul><li>a<li>b</ul></div></p>c", [(1, "a"), (1, "b"), (1, "c")]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", [(1, "1 2"), (1, "3")]),
    ("<p>k<span class='advert'>no</span>ept</p>", [(1, "kept"), (2, "no")]),
    ("<article class='comment'>c</article><article>a</article>",
     [(2, "c"), (0, "a")]),
    (None, []), ("", []), ("<" * 1000, [(1, "<" * 1000)])])
def test_blocks(page, want):
    assert html_blocks.blocks(page) == want


@pytest.mark.parametrize("page,want", [
    ("<article><section id='related-work'><h2 id='role-of-advertising'>a</h2>"
     "<p id='notice-period'>b</p><div class='social-science'>c</div></section>"
     "<div class='related-posts'>d</div><div id='share'>e</div></article>",
     [(0, "a"), (0, "b"), (0, "c"), (2, "d"), (2, "e")]),
    ("<h2 id='role-of-advertising'>a</h2><section id='related-work'>b"
     "</section><div id='main-nav'>c</div>", [(1, "a"), (1, "b"), (2, "c")]),
    ("<form id='aspnetForm' role='form'><nav>n</nav><article>text<select>"
     "<option>s</select></article><button>go</button></form>",
     [(2, "n"), (0, "text"), (2, "s"), (2, "go")]),
    ("<p>few</p><form><p>most of the text of a page</p><button>go</button>"
     "</form>", [(1, "few"), (1, "most of the text of a page"), (2, "go")]),
    ("<p>most of the text</p><form>find</form>",
     [(1, "most of the text"), (2, "find")])])
def test_blocks_keep_article_text_beside_hints_and_forms(page, want):
    assert html_blocks.blocks(page) == want


def test_blocks_of_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</p></i>" * 3000 + "</div>" * 3000 + "y"
    assert html_blocks.blocks(deep) == [(1, "x"), (1, "y")]
    assert len(html_blocks.blocks("<p>a" * 50_000)) == 50_000
    assert html_blocks.blocks("<p a='" + "x" * 200_000)[:1] == []


def test_range_coder_round_trips():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, top, n).astype(np.uint32)
              for top, n in ((50_000, 4096), (3, 4096), (2 ** 32, 700),
                             (2, 1), (50_000, 0), (65_536, 5000))]
    blocks += [np.full(9000, 7, np.uint32), np.arange(300, dtype=np.uint32)]
    data = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(
        blocks, range_coder.decode_blocks(data), strict=True))
    assert len(data[6]) < 200                     # it predicts
    # blocks are independent
    assert (range_coder.decode_blocks([data[1]])[0] == blocks[1]).all()
    assert range_coder.decode_blocks([]) == []
    for bad in (data[0][:-2], b"XXXX" + data[0][4:],
                data[0][:60] + bytes([data[0][60] ^ 1]) + data[0][61:]):
        with pytest.raises(ValueError):
            range_coder.decode_blocks([bad])


def test_range_coder_beats_zlib_at_little_cost():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 1 << 20), 50_000).astype(np.uint32)
    ids[1::7] = ids[::7][:len(ids[1::7])] + 1        # some can be predicted
    began = time.process_time()
    data = range_coder.encode_blocks([ids])
    back = range_coder.decode_blocks(data)
    # both ways; blocks with tables of their own took 3.7 and more
    assert time.process_time() - began < 2
    assert (back[0] == ids).all()
    assert len(data[0]) < len(zlib.compress(ids.astype("<u2").tobytes()))


def test_range_coder_lanes_of_any_length():
    rng = np.random.default_rng(3)
    lane = range_coder.LANE_IDS
    for n in (1, 2, lane, lane + 1, 3 * lane - 1, 7 * lane + 5,
              range_coder.BLOCK_IDS + 1):
        ids = (rng.integers(0, 50_000, n) * (rng.random(n) < 0.3)
               ).astype(np.uint32)
        if n < 9 * lane:
            ids[-1] = 2 ** 32 - 1
        got = range_coder.decode_blocks(range_coder.encode_blocks([ids]))
        assert (got[0] == ids).all()


def test_installed_encoder_is_kept_and_bounded():
    from tasklane.llm import kernel as K
    own = tokens.installed_encoder(token_output.VOCABULARY)
    assert own is tokens.installed_encoder(token_output.VOCABULARY)
    assert own.entries == tokens.KEPT_ENTRIES
    path = tokens.vocabulary(token_output.VOCABULARY)
    small, plain = tokens.json_encoder(path, 4), tokens.bpe_json(path)
    for text in ("one two three", " four five", " one six two three", ""):
        ids, _ = small.encode(*K.flat(pa.array([text])))
        assert ids.tolist() == list(plain([text])[0])
        assert len(small.known) <= 4


def test_moved_checksums():
    rng = np.random.default_rng(1)
    a, b = (rng.bytes(n) for n in (100, 12345))
    moved = token_output.crc_moved(np.array([zlib.crc32(a)], np.uint32),
                                   np.array([len(b)]))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_token_files_hold_every_document(spark, tmp_path):
    from tokenizers import Tokenizer
    rows = [(5, None), (None, "hi é"), (5, "there"), (5, "there"), (1, ""),
            (7, "x " * 30_000), (8, "y z"), (9, "# 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "start", F.lit("clash"))
    path = str(tmp_path / "tokens")
    token_output.write_tokens(df, path, block_ids=512)
    got = token_output.read_documents(spark, path).orderBy("start").collect()
    own = Tokenizer.from_file(tokens.vocabulary(token_output.VOCABULARY))
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in docs]
    want = {}
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append(
            (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    ids = [i for r in token_output.read_ids(spark, path).orderBy(
        "part", "block").collect() for i in r.ids]
    assert len(ids) == at
    assert zlib.crc32(np.array(ids[:got[0].n_tokens], "<u4").tobytes()
                      ) == got[0].ids_crc32
    empty = token_output.token_output(df.where("false"),
                                      str(tmp_path / "none"))
    assert empty.count() == 0
    lost = spark.read.parquet(path).where("block != 3")
    lost.write.parquet(str(tmp_path / "lost"))
    with pytest.raises(Exception, match="piece of a document is missing"):
        token_output.read_documents(spark, str(tmp_path / "lost")).collect()
    assert pa.__version__
