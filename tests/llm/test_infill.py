import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockmill.llm import infill, tables


def brute(key, text, unit, percent=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    digits = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["lines", "chars"])
def test_batches_equal_plain_string_work(unit):
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 2, 3, 7, 8, 9, 40]) for _ in range(rng.randint(0, 9))]
        texts = ["".join(rng.choice("ab\n\né漢😀Ċ<SMP>\x00") for _ in range(n)) for n in sizes]
        keys = [str(rng.randrange(10**6)) for _ in texts]
        columns = infill.transform_batch(pa.array(texts, pa.string()), keys, unit, 100, 50, "7:")
        got = list(zip(*(c.to_pylist() for c in columns)))
        assert got == [brute(k, t, unit) for k, t in zip(keys, texts)]
        assert [infill.restore(g[4].encode(), g[1]).decode() for g in got] == texts


ROWS = [
    (1, "one\ntwo\nthree\n"), (2, "no line feed"), (3, ""), (4, None), (None, "a\nb\nc"), (5, "x <S> y\nz"),
    (6, "\n\n\n"), (7, "é漢\n😀" * 50_000), (1, "one\ntwo\nthree\n"), (8, "<P\n>S>\n<M"), (9, "ab<\nS\n>cd<M\n"),
]


@pytest.mark.parametrize("unit, percent", [("lines", 100), ("chars", 100), ("lines", 40)])
def test_operator_keeps_rows_and_columns(spark, unit, percent, monkeypatch):
    monkeypatch.setattr(tables, "SLICE_BYTES", 100)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(
        {"form": F.lit("old"), "n_units": F.lit(-1), "a b": F.lit("kept")}
    )
    made = infill.infill_examples(df, "doc_id", unit=unit, percent=percent)
    assert made.columns == ["doc_id", "text", "a b", *infill.ADDED.names]
    got = infill.restored(made).collect()
    want = [(k, t, "kept", *brute(k, t, unit, percent), t or "") for k, t in ROWS]
    key = repr
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_empty_table_and_wrong_unit(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.example_digests(df).count() == 0
    with pytest.raises(ValueError, match="lines or chars"):
        infill.infill_examples(df, "doc_id", unit="words")
    with pytest.raises(ValueError, match="form psm"):
        infill.restore(b"text", "psm")
