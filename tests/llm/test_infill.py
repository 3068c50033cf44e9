"""Fill-in-the-middle: units, ranked bits, forms and restoring, against plain string code."""

import hashlib
import random
import re

import pytest

from wellframe.llm import infill

PLAIN = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"(?s)\A[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}
ALPHABET = "ab \n\té漢🙂<P>SM"


def texts(n=400, seed=5):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.choice([0, 1, 2, 5, 40, 300]))) for _ in range(n)]
    return [*out, "\n", "\n\n\n", "x", "x\n", " \n ", "é" * 5000 + "\n" + "漢字\n" * 3000]


@pytest.mark.parametrize("unit", list(PLAIN))
def test_units(unit):
    for t in texts():
        want = re.findall(PLAIN[unit], t)
        b = t.encode()
        bits = infill.UNITS[unit](b) if b else 0
        assert bits.bit_count() == len(want)
        ends = [infill.cut(bits, len(b), k) for k in range(len(want) + 1)] if len(want) < 400 else []
        assert [b[x:y].decode() for x, y in zip(ends, ends[1:], strict=False)] == (want if ends else [])


def test_select():
    r = random.Random(3)
    for width in (1, 2, 3, 63, 64, 65, 1000, 4097):
        bits = r.getrandbits(width) | 1
        places = [i for i in range(width) if bits >> i & 1]
        assert [infill.select(bits, k) for k in range(len(places))] == places


@pytest.mark.parametrize("f", [infill.Format(), infill.Format(unit="word", seed="x", transform_rate=60, spm_rate=20), infill.Format(unit="char", spm_rate=100, prefix="[pre]", suffix="[suf]", middle="[mid]")])
def test_transform_and_restore(spark, f):
    rows = [(i if i % 7 else None, t, "z") for i, t in enumerate(texts(150))] + [(1, None, "z"), (2, "", "z"), (2, "", "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, output string")
    out = infill.transform(df, "id", "text", f)
    out = out.withColumn("back", infill.restored(out.output, out.form, f)).collect()
    assert len(out) == len(rows)
    got = sorted(repr((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in out)
    want = []
    for i, t, _ in rows:
        t = t or ""
        units = re.findall(PLAIN[f.unit], t)
        h = hashlib.sha256(f"{f.seed}:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        if not t or any(s in t for s in (f.prefix, f.suffix, f.middle)) or h[2] % 100 >= f.transform_rate:
            want.append(repr((i, len(units), "plain", None, None, t, t)))
            continue
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form, text = ("spm", f.suffix + suf + f.prefix + pre + f.middle + mid) if h[3] % 100 < f.spm_rate else ("psm", f.prefix + pre + f.suffix + suf + f.middle + mid)
        want.append(repr((i, len(units), form, len(pre), len(mid), text, t)))
    assert got == sorted(want)


def test_bad_formats_and_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert infill.transform(df, "id", "text").collect() == []
    for f in (infill.Format(prefix="aa"), infill.Format(suffix=">x"), infill.Format(middle="<P>"), infill.Format(unit="page"), infill.Format(prefix="")):
        with pytest.raises(ValueError):
            infill.transform(df, "id", "text", f)
