"""Hard negatives, conversation repair and best-fit packing, against brute
force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tasklane.llm import best_fit, conversation_repair, hard_negatives, tokens
from tasklane.llm.common import arrow_map, batch_rows

# ---- hard negatives ------------------------------------------------------

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def _mined(rows, k=5, m=5):
    whole = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(
                x is None or not np.isfinite(x) for x in v):
            continue
        whole.setdefault(i, set()).add(
            (label, tuple(int(np.floor(256 * float(np.float32(x))))
                          for x in v)))
    out = []
    for a in whole:
        if a % 100:
            continue
        label, own = min(whole[a])
        pairs = sorted({(-sum(x * y for x, y in zip(own, v)), i, c == label)
                        for i, rs in whole.items() if i != a for c, v in rs})
        for s, p, _ in [x for x in pairs if x[2]][:k]:
            hits = [x for x in pairs if not x[2]
                    and 80 * -s <= 100 * -x[0] <= 100 * -s][:m]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in
                    enumerate(hits, 1)]
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _embeddings(seed, n, dim, labels, step=0.25):
    rng = np.random.default_rng(seed)
    return [(int(i) * 25 - 300, (rng.integers(-3, 5, dim) * step).tolist(),
             int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_mining_is_brute_force(spark, block):
    rows = _embeddings(3, 160, 6, 3) + [
        (None, [1.0], 1), (7, None, 1), (8, [1.0], None),
        (9, [None, 1.0], 1), (10, [float("nan")], 1),
        (11, [float("inf"), 2.0], 0), (12, [], 1), (13, [1.5], 2)]
    rows += rows[:40]                              # exact repeats
    rows += [(200, [2.0] * 6, 0), (225, [2.0] * 6, 1)]    # ids with two rows
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(5).withColumn(
        "score", F.lit("x")).withColumn("anchor", F.lit(1))
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0,
                              block_anchors=block)
    want = _mined(rows)
    assert len(want) > 50 and _rows(got) == want


def test_mining_of_equal_vectors_and_hot_labels(spark):
    rows = [(i, [1.0, 0.5], 0 if i % 3 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(7)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert _rows(got) == _mined(rows)


def test_mining_without_rows_anchors_or_pairs(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)],
                 [(100, [1.0], 1), (2, [1.0], 2)],
                 [(100, [-1.0], 1), (2, [1.0], 1), (3, [1.0], 2)]):
        df = spark.createDataFrame(rows, EMBEDDINGS)
        assert _rows(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) \
            == _mined(rows)


def test_large_components_stay_exact():
    a = np.array([[2.0 ** 28 + 1, 3.0]])
    b = np.array([[2.0 ** 28 + 3, -1.0]])
    assert hard_negatives._scores(a, b)[0, 0] == (2 ** 28 + 1) * (
        2 ** 28 + 3) - 3
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives._scores(a * 2 ** 20, b * 2 ** 20)


def test_windows_hold_no_anchor():
    """The iterator reads on while it emits: it never waits for the end."""
    keys = sorted(hard_negatives._packed(
        np.full(1000, 5), np.arange(1000), np.arange(1000), 0)
        + hard_negatives._packed(np.array([5]), np.array([990]),
                                 np.array([-4]), 1))
    read = []

    def stream():
        for k in keys:
            read.append(k)
            yield k
    it = hard_negatives.open_windows(stream(), 5, 5, (80, 100))
    assert next(it) == (5, -4, 1, 990, 990, 990)
    assert len(read) < 20
    assert [r[3] for r in it] == [989, 988, 987, 986]


# ---- conversation repair -------------------------------------------------

def _cheapest(codes):
    """(cost, audit) by trying all edits, from the end."""
    best = {0: (0, ""), 3: (0, "")}
    best[2] = (2, "I")
    best[1] = (4, "II")
    nxt = conversation_repair._NEXT
    for code in reversed(codes):
        new = {}
        for s in range(4):
            options, state, head, cost = [], s, "", 0
            for _ in range(4):                     # up to three insertions
                options.append((cost + 3 + best[state][0],
                                head + "D" + best[state][1]))
                if code & 3 < 2:
                    extra = code & 3
                    to = conversation_repair._KEEPS[state].get(code >> 2)
                    if to is not None:
                        options.append((cost + extra + best[to][0],
                                        head + "K" + best[to][1]))
                    to = nxt[state]
                    options.append((cost + 2 + extra + best[to][0],
                                    head + "R" + best[to][1]))
                head, cost, state = head + "I", cost + 2, nxt[state]
            new[s] = min(options)
        best = new
    return best[0]


def test_auction_finds_the_least_of_the_cheapest_edits():
    rng = random.Random(4)
    assert conversation_repair.cheapest_edits(b"") == (0, "")
    for n in [*range(1, 9)] * 60 + [63, 64, 65, 130, 400, 1000]:
        codes = bytes(rng.choice((0, 4, 4, 8, 8, 12)) + rng.choice(
            (0, 0, 0, 1, 2, 3)) for _ in range(n))
        assert conversation_repair._solve(codes) == _cheapest(codes), codes


def test_prices_allow_all_arcs_and_reach_the_distance():
    arcs = [[(1, 2), (2, 5)], [(2, 2), (3, 9)], [(1, 1), (3, 3)], []]
    price = [0, 0, 0, 0]
    conversation_repair.auction(arcs, price, 0, 3)
    assert price[0] == 7
    assert all(price[i] <= c + price[j]
               for i, a in enumerate(arcs) for j, c in a)


WORD = re.compile(r"[^\x20\x09-\x0D]")


def _repaired(rows):
    """The contract, row by row."""
    plain = [tuple(" " if x is None else x for x in r) for r in rows]
    convs = defaultdict(list)
    for (c, t, _, _), (pc, pt, role, text) in zip(rows, plain, strict=True):
        case = zlib.crc32(f"{pc}:{pt}".encode()) % 20
        convs[c]
        if case == 0:
            continue
        text = "" if case == 1 else re.sub(
            "[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        convs[c] += [(t, role, text)] * (2 if case == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                hashlib.md5(r[2].encode()).digest()))
        seen, codes, n = set(), [], [0] * 4
        for _, role, text in own:
            letters = WORD.findall(text)
            fault = (2 if not letters else 3 if (role, text) in seen
                     else 1 if letters[-1] not in ".!?" else 0)
            seen.add((role, text))
            n[fault] += 1
            first = "sua".find(role[:1]) if role else -1
            codes.append(4 * (3 if first < 0 else first) + fault)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(
            (a[1][:1] + b[1][:1]) not in ("su", "ua", "au")
            for a, b in zip(own, own[1:]))
        cost, audit = _cheapest(codes)
        lines, it, system = [], iter(own), False
        for letter in audit:
            row = next(it) if letter != "I" else None
            turn = (len(lines) - system) % 2
            role = ("user", "assistant")[turn]
            if letter == "K":
                lines.append(f"{row[1]}:{row[2]}")
                system = system or len(lines) == 1 and row[1][:1] == "s"
            elif letter != "D":
                lines.append(f"{role}:{row[2] if row else ''}")
        out.append((c, gaps, n[2], n[3], n[1], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


CONV = "conv_id long, turn long, role string, text string"


def _repair_of(df):
    return conversation_repair.repair(conversation_repair.damaged(df),
                                      F.col("gone"))


def _by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_repair_is_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for c in [None, *range(-2, 250)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice((t, t, t, t + 2, None)), rng.choice(
                ("system", "user", "assistant", "user", "assistant", None,
                 "", "tool", "sage")), rng.choice(
                ("Yes.", "No!", "Why", "", None, " \t\n", "a.\x0b", "é…",
                 f"{c} {t}.", f"x{t}? "))))
    rows += rows[:60]
    rows += [(999, t, ("user", "assistant")[t % 2], f"{t} ok.")
             for t in range(700)]                  # a long conversation
    rows += [(1000, 1, "user", "same.")] * 300     # a row many times
    rows += [(1001, 3, "user", "very long. " * 100_000)]
    df = spark.createDataFrame(rows, CONV).repartition(6).withColumn(
        "digest", F.lit(3)).withColumn("kind", F.lit(None).cast("int"))
    got = _repair_of(df)
    assert got.columns == [*conversation_repair._AUDIT.names,
                           "repaired_sha256"]
    assert _by_id(map(tuple, got.collect())) == _by_id(_repaired(rows))


def test_repair_of_nothing(spark):
    assert not _repair_of(spark.createDataFrame([], CONV)).count()
    gone = [(i, 0, "user", "x.") for i in range(99)
            if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    assert gone
    for r in _repair_of(spark.createDataFrame(gone, CONV)).collect():
        assert tuple(r[1:7]) == (0,) * 6 and r.audit == ""
        assert r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_repair_query_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(
        f"{sf_dir}/conversations.parquet").collect()]
    got = conversation_repair.op12_conversation_repair(spark, sf_dir)
    assert _by_id(map(tuple, got.collect())) == _by_id(_repaired(rows))


# ---- best-fit packing ----------------------------------------------------

def _best_fit(lengths, capacity):
    """Rooms left in the sequences, one piece after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_placing_counts_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice((1, 2, 7, 16, 33))
        lengths = [rng.randrange(1, capacity + 1)
                   for _ in range(rng.randrange(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = best_fit.place(counts, capacity)
        sort = np.array(sorted(lengths), np.int64)
        rank = np.array([k for n in sorted(counts)
                         for k in range(counts[n])], np.int64)
        if not len(sort):
            assert not len(rows)
            continue
        sequence, offset = best_fit.lookup(rows, sort, rank, capacity)
        _assert_gapless(sequence, offset, sort, capacity)
        used = defaultdict(int)
        for s, n in zip(sequence.tolist(), sort.tolist(), strict=True):
            used[s] += n
        assert sorted(capacity - u for u in used.values()) == _best_fit(
            lengths, capacity)


def _assert_gapless(sequence, offset, length, capacity):
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    new = np.r_[True, s[1:] != s[:-1]]
    assert (o[new] == 0).all()
    assert (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all()
    assert ((o + n) <= capacity).all()


def test_placing_many_is_quick_and_bounded():
    rows = best_fit.place({n: 10 ** 9 + 7 * n for n in range(1, 1025)}, 1024)
    assert len(rows) < 50_000


def test_tree_finds_the_tightest():
    tree = best_fit.CapacityTree(10)
    for room in (3, 3, 7, 10):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    tree.add(10, -1)
    assert tree.tightest(8) is None


def _assert_packed(got, texts, capacity):
    encode = tokens.bpe_json(tokens.vocabulary(best_fit.VOCABULARY))
    ids = [x + [2] for x in encode([t or "" for _, t in texts])]
    want, lengths = [], []
    for (key, _), x in zip(texts, ids, strict=True):
        head = len(x) % capacity or capacity
        cuts = [0, *range(head, len(x), capacity)]
        for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(x)])):
            want.append((key, p, a, b - a, zlib.crc32(
                np.array(x[a:b], "<u4").tobytes())))
            lengths.append(b - a)
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(
        want, key=str)
    s, o, n = (np.array([r[i] for r in got], np.int64) for i in (5, 6, 3))
    _assert_gapless(s, o, n, capacity)
    rooms = sorted(capacity - u for u in np.bincount(
        np.unique(s, return_inverse=True)[1], n).astype(int).tolist())
    assert rooms == _best_fit(lengths, capacity)


def test_packing_is_brute_force(spark):
    rng = random.Random(6)
    texts = [(None, None), (None, "a b"), (1, ""), (1, ""), (2, " \n"),
             (3, "word " * 5000), (4, "é" * 900), (-5, "x" * 40_000)]
    texts += [(i, "lorem ipsum " * rng.randrange(30)) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(
        5).withColumn("length", F.lit("?")).withColumn("part", F.lit(0.5))
    for capacity in (64, 1024):
        _assert_packed(best_fit.pack(df, capacity).collect(), texts, capacity)


def test_packing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert not best_fit.pack(df).count()


def test_packing_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(
        f"{sf_dir}/documents.parquet").collect()]
    got = best_fit.op13_best_fit_packing(spark, sf_dir).collect()
    _assert_packed(got, texts, 1024)


def test_packing_tasks_open_no_file_each(spark):
    """24 tasks encode; their few pieces are gathered before they're
    written."""
    from pathlib import Path
    from tasklane.session import checkpoint_dir
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    there = set(folder.glob("packing-*"))
    texts = [(i, "lorem ipsum " * (i % 7)) for i in range(96)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    _assert_packed(best_fit.pack(df.repartition(24), 64).collect(), texts, 64)
    (new,) = set(folder.glob("packing-*")) - there
    assert 1 <= len(list(new.glob("*.parquet"))) < 12


def test_equal_lengths_are_taken_in_file_order(spark, tmp_path):
    path = str(tmp_path / "documents")
    for key in range(4):
        spark.createDataFrame([(key * 10 + i, "a b c") for i in range(9, 0, -1)
                               ], "doc_id long, text string").coalesce(
            1).write.mode("append").parquet(path)
    rows = spark.read.parquet(path)
    want = [r.doc_id for r in rows.collect()]
    got = best_fit.pack(rows, 4).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in got] == want


def test_tasks_of_a_worker_share_an_encoder(monkeypatch):
    made, encoder = [], tokens.json_encoder
    monkeypatch.setattr(tokens, "json_encoder",
                        lambda *a: made.append(a) or encoder(*a))
    monkeypatch.setattr(best_fit.TaskContext, "get", lambda: type(
        "Task", (), {"partitionId": lambda self: 3})())
    tokens.installed_encoder.cache_clear()
    schema = to_arrow_schema(best_fit._PIECES)
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["a b", None]})
    run = best_fit._piece_batches(None, best_fit.END_ID, 64)
    first, second = ([b.to_pylist() for b in run(iter([batch, batch]), schema)]
                     for _ in range(2))
    assert first == second and len(made) == 1
    assert [(r["part"], r["pos"]) for b in first for r in b] == [
        (3, n) for n in range(4)]


def test_arrow_batches_are_small_meanwhile(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def largest():
        return max(r.id for r in arrow_map(
            spark.range(0, 3000, 1, 1), lambda batches, schema: (
                pa.RecordBatch.from_arrays([pa.array([b.num_rows])],
                                           schema=schema) for b in batches),
            spark.range(1).schema).collect())
    before = spark.conf.get(name, None)
    try:
        for own in (None, "2000", "0", "70"):
            spark.conf.unset(name) if own is None else spark.conf.set(
                name, own)
            with batch_rows(spark, 100):
                assert largest() == (70 if own == "70" else 100)
            assert spark.conf.get(name, None) == own
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(
            name, before)


def test_packing_reads_texts_in_small_batches(spark, monkeypatch):
    """Batches of the size that ``pack`` asks for while it encodes; the
    session's setting is back afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch",
             "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name, None) for name in names]
    batches = best_fit._piece_batches

    def checked(*args):
        def run(given, schema):
            def small():
                for batch in given:
                    assert batch.num_rows <= 512
                    yield batch
            return batches(*args)(small(), schema)
        return run
    monkeypatch.setattr(best_fit, "_piece_batches", checked)
    df = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "'a b' text")
    assert best_fit.pack(df).count() == 4000
    assert [spark.conf.get(name, None) for name in names] == before
