"""Conversation repair: the chart against every edit script, the reports and repairs against plain code."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from wellframe.llm import dialogue, queries

SOUND = re.compile(r"(s?(ua)+)?\Z")
GAPS = ["", "u", "a", "ua", "au", "uu", "aa"]


def every_script(codes):
    """The least (cost, audit) over all edit scripts with at most two inserted turns at a place."""
    options = []
    for c in codes:
        initial, fault = "suax"[c // 3], c % 3
        own = [("", 4, "D")]
        if fault != dialogue.GONE:
            extra = 3 * (fault == dialogue.CUT)
            own += [(initial, extra, "K"), ("u", 3 + extra, "R"), ("a", 3 + extra, "R")]
        options += [[(g, 3 * len(g), "I" * len(g)) for g in GAPS], own]
    options.append([(g, 3 * len(g), "I" * len(g)) for g in GAPS])
    best = None
    for script in itertools.product(*options):
        if SOUND.match("".join(x[0] for x in script)):
            value = sum(x[1] for x in script), "".join(x[2] for x in script)
            best = min(best or value, value)
    return best


def backwards(codes):
    """The same by dynamic programming from the end over the automaton of (s?(ua)+)?; independent of the chart."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"0": (0, ""), "a": (0, ""), "s": None, "u": None}

    def insertions(values):
        while True:
            new = dict(values)
            for (p, t), q in step.items():
                if t in "ua" and values[q] is not None:
                    v = (values[q][0] + 3, "I" + values[q][1])
                    new[p] = min(new[p] or v, v)
            if new == values:
                return values
            values = new

    best = insertions(best)
    for c in reversed(codes):
        initial, fault = "suax"[c // 3], c % 3
        new = {p: (v[0] + 4, "D" + v[1]) if v else None for p, v in best.items()}
        if fault != dialogue.GONE:
            extra = 3 * (fault == dialogue.CUT)
            for (p, t), q in step.items():
                if best[q] is not None and (t == initial or t in "ua"):
                    v = (best[q][0] + extra + 3 * (t != initial), ("K" if t == initial else "R") + best[q][1])
                    new[p] = min(new[p] or v, v)
        best = insertions(new)
    return best["0"]


def test_chart_equals_every_script():
    for n in (0, 1, 2):
        for codes in itertools.product(range(12), repeat=n):
            assert dialogue.parse(bytes(codes)) == every_script(codes) == backwards(codes)
    r = random.Random(1)
    for _ in range(6):
        codes = [r.randrange(12) for _ in range(3)]
        assert dialogue.parse(bytes(codes)) == every_script(codes)


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_long_charts_and_blocks(block):
    r = random.Random(block)
    for _ in range(60):
        n = r.choice([5, 17, 60, 200])
        weights = r.choice([[1] * 12, [1, 0, 0, 9, 1, 1, 9, 1, 1, 1, 1, 1], [0] * 9 + [1, 1, 1]])
        codes = r.choices(range(12), weights, k=n)
        chart = dialogue.Chart()
        for lo in range(0, n, block):
            chart.advance(bytes(codes[lo : lo + block]))
        assert chart.result() == backwards(codes)


def plainly(rows):
    """Report and repaired turns of one conversation's rows (turn, role, text), in order."""
    seen, faults, codes = set(), [0, 0, 0], []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            faults[fault - 1] += 1
        codes.append(3 * ("sua".index(role[0]) if role[:1] in tuple("sua") else 3) + (0, 1, 1, 2)[fault])
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = backwards(codes)
    out, left = [], list(rows)
    for e in audit:
        turn = left.pop(0) if e != "I" else (None, "", "")
        if e != "D":
            given = "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((turn[1] if e == "K" else given, turn[2]))
    assert SOUND.match("".join(role[:1] for role, _ in out))
    return gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def in_order(rows):
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = "user" if k == 4 else sp(role), {1: "", 2: re.sub("[.!?]", "", sp(text))}.get(k, sp(text))
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return {c: plainly(in_order(v)) for c, v in out.items()}


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_equals_plain_code(spark, sf):
    for folder in (sf, "/root/testdata/sf0.1"):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert result(queries.op13_conversation_repair(spark, folder)) == damaged(rows)


def test_odd_rows(spark, tmp_path):
    r = random.Random(9)
    texts = ["Yes.", "No", "", None, " \t\n", "What?! ", "long " * 5000 + ".", "é.", " "]
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, 0, 1, 2, 5, 2**40, -3]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(texts)) for _ in range(300)]
    rows += [(77, 0, "user", "a.")] * 5 + [(78, None, None, None)]
    zero = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((zero, 0, "user", "gone."))
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = result(queries.op13_conversation_repair(spark, str(tmp_path)))
    assert got == damaged(rows)
    assert got[zero] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation_and_none(spark):
    r = random.Random(4)
    rows = [(1, i, r.choice(["user", "assistant", "x"]), r.choice(["a.", "b", f"{i}."])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string")
    audits = dialogue.parsed(df, "c", "t", "r", "x").collect()
    want = plainly([x[1:] for x in rows])
    assert [tuple(a)[1:] for a in audits] == [want[:-1]]
    out = dialogue.repaired(df, "c", "t", "r", "x", spark.createDataFrame(audits)).collect()
    assert [x.position for x in out] == list(range(len(out)))
    assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in out).encode()).hexdigest() == want[-1]
    none = df.limit(0)
    assert dialogue.parsed(none, "c", "t", "r", "x").collect() == [] == dialogue.repaired(none, "c", "t", "r", "x", dialogue.parsed(none, "c", "t", "r", "x")).collect()
