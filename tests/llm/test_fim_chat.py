"""Fill-in-the-middle and chat formatting against plain versions, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rowcensus.llm.chat import Contents, Template, assembled, digest_chats, format_chats, reader, unescaped
from rowcensus.llm.fim import Boundaries, Mix, fill_in_middle, restored
from rowcensus.llm.wavelet import WaveletMatrix
from rowcensus.llm.words import text_buffers

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
ODD_TEXTS = [
    None, "", " ", "a", "a ", " a", "\n\n", "a\nb\n", "Ä ö\u00a0日本 \t x", "x" * 100_000, "w " * 50_000, "holds <P> itself",
    "ends with <", "<P", "S> <M", "<" * 50, "a\x00b c", "one\r\ntwo\r\n\r\nthree",
]


def middle(i, text, pattern=UNIT, changed=50):
    """(n, form, output, prefix_chars, middle_chars) by slices of the list of units."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = pattern.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= changed:
        return n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_ranks_of_a_wavelet_matrix():
    r = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = r.integers(0, 16, n, dtype=np.uint8)
        matrix, at = WaveletMatrix(symbols, 4), np.arange(n + 1)
        for symbol in range(16):
            assert matrix.rank(symbol, at).tolist() == [int((symbols[:k] == symbol).sum()) for k in at]
        for upper in range(4):
            assert matrix.rank(upper, at, 2).tolist() == [int((symbols[:k] >> 2 == upper).sum()) for k in at]


@pytest.mark.parametrize("unit,pattern", [("words", UNIT), ("lines", LINE)])
def test_every_cut_of_a_text(unit, pattern):
    texts = [t or "" for t in ODD_TEXTS if len(t or "") < 100]
    data, bounds = text_buffers(pa.array(texts))
    found = Boundaries(data, bounds, unit)
    assert found.units.tolist() == [len(pattern.findall(t)) for t in texts]
    for k in range(max(found.units) + 1):
        at = found.after(np.full(len(texts), k))
        want = [len("".join(pattern.findall(t)[:k]).encode()) for t in texts]
        assert (at - bounds[:-1]).tolist() == want
        assert found.code_points(bounds[:-1], at).tolist() == [len("".join(pattern.findall(t)[:k])) for t in texts]


def test_cuts_at_the_end_of_a_slice_of_any_length():
    for n in range(200):
        text = ("ab " * n)[:n]
        found = Boundaries(*text_buffers(pa.array([text])), "words")
        assert found.after(found.units).tolist() == [n]


@pytest.mark.parametrize("slice_bytes", [16, 1 << 18])
def test_middles_of_odd_rows(documents, slice_bytes):
    rows = list(enumerate(ODD_TEXTS * 4)) + [(3, "a b c d"), (3, "a b c d"), (None, "a b c d e f"), (None, None), (-5, "x y z")]
    found = fill_in_middle(documents(rows), slice_bytes=slice_bytes).withColumn("again", restored())
    got = sorted((repr((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars)) for r in found.collect()))
    assert got == sorted(repr((i, *middle(i, t))) for i, t in rows)
    assert sorted(r.again for r in found.collect()) == sorted(t or "" for _, t in rows)


def test_middles_of_lines_in_other_shares(documents):
    rows = [(i, f"a{i}\nb\n\nc d\n"[: i % 13]) for i in range(200)]
    found = fill_in_middle(documents(rows), unit="lines", mix=Mix(changed=100)).withColumn("again", restored()).collect()
    for r in found:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == middle(r.doc_id, rows[r.doc_id][1], LINE, 100)
        assert r.again == rows[r.doc_id][1]
    with pytest.raises(ValueError):
        fill_in_middle(documents(rows), unit="pages")


def test_middles_of_no_rows(documents):
    assert fill_in_middle(documents([])).collect() == []


# --- chats ---------------------------------------------------------------------------------

PARTS = ["<turn>", "<says>", "</turn>", "\\", "\\\\", "<", ">", "turn>", "a", " ", "ä", "日", "\n", "/"]


def odd_content(r):
    return "".join(r.choice(PARTS) for _ in range(r.randrange(12)))


def escaped(text):
    """The escape rule by a regular expression."""
    text = re.sub(r"(\\*)(<turn>|<says>|</turn>)", r"\1\1\\\2", text)
    return re.sub(r"\\+\Z", lambda m: m.group() * 2, text)


def plain_chats(rows):
    """{conv: (n, turns digest, loss length, loss digest, formatted length)} one after the other."""
    found = {}
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x[:2]) + ((x[2] or "").encode(), (x[3] or "").encode())
    for conv, _, role, text in sorted(rows, key=key):
        found.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        told = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        chars = sum(len(escaped(a)) + len(escaped(b)) + 19 for a, b in turns)
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def turns_frame(spark, rows, slices=3):
    schema = "conv_id long, turn long, role string, text string, conv string, part long, whole boolean, formatted string"
    return spark.createDataFrame([(*r, "x", None, None, None) for r in rows], schema).repartition(slices)


def digests(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


def test_assembly_of_columns():
    r = random.Random(5)
    marks = [c.encode() for c in Template().controls()]
    read, pattern = reader(), re.compile("<turn>|<says>|</turn>")
    for _ in range(60):
        n = r.randrange(1, 9)
        roles, texts = ([odd_content(r) for _ in range(n)] for _ in range(2))
        if r.random() < 0.2:
            texts[0] = "ab\\" * 5000 + "<turn>" + "z" * 9000
        runs = np.array(sorted({0, *(r.randrange(n) for _ in range(2))}))
        learned = np.array([r.random() < 0.5 for _ in range(n)])
        column, loss = assembled(*(Contents(*text_buffers(pa.array(c)), marks) for c in (roles, texts)), marks, runs, learned)
        for k, (formatted, spans) in enumerate(zip(column.to_pylist(), loss.to_pylist())):
            mine = range(runs[k], runs[k + 1] if k + 1 < len(runs) else n)
            assert formatted == "".join(f"<turn>{escaped(roles[i])}<says>{escaped(texts[i])}</turn>" for i in mine)
            assert read(formatted) == [(roles[i], texts[i]) for i in mine]
            assert [unescaped(formatted[s["start"] : s["end"]], pattern) for s in spans] == [texts[i] for i in mine if learned[i]]


@pytest.mark.parametrize("slice_bytes", [40, 1 << 18])
def test_chats_of_odd_rows(spark, slice_bytes):
    r = random.Random(9)
    rows = [(r.choice([None, 1, 2, -7, 50, 51, 52]), r.choice([None, 0, 1, 2, 3]), r.choice(["user", "assistant", None, "<says>", ""]), r.choice([None, odd_content(r)])) for _ in range(150)]
    rows += [(9, k, "assistant", f"turn {k} \\") for k in range(300)] + rows[:5] + [(70, 0, "assistant", "x\\" * 100_000)]
    found = digest_chats(format_chats(turns_frame(spark, rows), slice_bytes=slice_bytes))
    assert digests(found) == plain_chats(rows)


def test_a_long_conversation_is_formatted_by_many_tasks(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", "w" * (k % 50)) for k in range(4000)] + [(k, 0, "user", "x") for k in range(2, 60)]
    with_parts = format_chats(turns_frame(spark, rows, 8), slice_bytes=2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        holders = {r.part >> 33 for r in with_parts.where("conv_id = 1").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(holders) >= 3
    assert digests(digest_chats(with_parts)) == plain_chats(rows)


def test_chats_of_no_rows(spark):
    assert digest_chats(format_chats(turns_frame(spark, []))).collect() == []


def test_templates(spark):
    for wrong in (("", "b", "c"), ("a\\", "b", "c"), ("ab", "bc", "d"), ("abc", "b", "d"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            Template(*wrong)
    other = Template("### ", ": ", "@@@\n", learned="bot")
    rows = [(1, 0, "a: b", "### x: \\"), (1, 1, "bot", "@@@\n\\@@@\n"), (2, 0, "bot", None)]
    parts = format_chats(turns_frame(spark, rows), template=other)
    read = reader(other)
    told = {}
    for r in parts.orderBy("conv_id", "part").collect():
        told.setdefault(r.conv_id, []).extend(read(r.formatted))
    assert told == {1: [("a: b", "### x: \\"), ("bot", "@@@\n\\@@@\n")], 2: [("bot", "")]}
    found = digests(digest_chats(parts, template=other))
    assert found[1][3] == hashlib.sha256(b"@@@\n\\@@@\n").hexdigest()
    with pytest.raises(ValueError):
        read("### a")
