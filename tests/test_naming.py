"""T8's replacement kernel against ``str.translate``."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tasklane.functions import naming
from tasklane.operators import vocab as V

LEXICON = {"😭": ":大声哭喊的脸:", "a": "", "é": "e", "漢": "<han>", "z": "zz",
           "\U0010ffff": "last", "no": "match", "~": "😭"}


def _want(texts):
    table = {ord(k): v for k, v in LEXICON.items() if len(k) == 1}
    return [None if t is None else t.translate(table) for t in texts]


@pytest.mark.parametrize("limit", [1, 7, 1 << 22])
def test_kernel_is_translate(monkeypatch, limit):
    monkeypatch.setattr(naming, "SLICE_BYTES", limit)
    rng = random.Random(limit)
    texts = [None, "", "a", "😭", "no match", "\U0010ffff", "aaaa", None] + [
        "".join(rng.choice("abcé漢字😭😀z~ \U0010ffff") for _ in range(
            rng.randrange(40))) for _ in range(300)] + [None]
    names = naming.Lexicon(LEXICON)
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind), pa.array(texts, kind)[3:-5]):
            assert names(column).to_pylist() == _want(column.to_pylist())
            assert names(column).type == kind
    assert names(pa.array([], pa.string())).to_pylist() == []
    assert names(pa.array([None], pa.string())).to_pylist() == [None]
    assert naming.Lexicon({"ab": "x"})(pa.array(["ab"])).to_pylist() == ["ab"]


def test_table_form_with_and_without_a_join(spark, monkeypatch):
    texts = ["a😭é", "", None, "漢漢z", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lex = spark.createDataFrame(
        [*LEXICON.items(), ("é", "x"), ("z", None), (None, "q")],
        "ch string, rep string")
    for most in (32 << 20, 0):
        monkeypatch.setattr(V, "LEXICON_BYTES", most)
        got = V.replace_chars_table(df, "id", "text", lex)
        assert [r.text for r in got.orderBy("id").collect()] == _want(texts)
