from __future__ import annotations

import datetime as dt
import hashlib
import random
import re

import odd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, pii, url_filter
from palimpsest.llm.queries import op4_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"\D", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def noisy(seed: int) -> str:
    """Fragments of what the patterns look for, in every wrong order."""
    rng = random.Random(seed)
    bits = ["a@b.c", "x.y+z@d-e.co.uk", "@", ".", "..", "_", "%", "-", " ", "  ", "\n", "é", "\U0001f600", "1.2.3.4", "255.255.255.256", "001.02.3.0004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (017) 555-7713", "+", "++1", "(", ")", "0", "7", "12345678901234567890123", "contact a (at) b.com", "call 415-555-0199 ", "2001:db8:1:2:3:4:5:6", "a@b", "a@b.", "a@.b"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(40)))


def test_base_spans_match_brute_force(spark):
    rows = odd.documents() + [(200 + i, noisy(i), *odd.REST) for i in range(300)] + [(900, "a." * 20_000 + "@" + "b." * 20_000 + "c", *odd.REST), (901, "1 " * 20_000 + "+1" + " " * 30_000, *odd.REST), (902, "x@y.zz " * 3000, *odd.REST)]
    done = pii.find_pii(odd.frame(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), [(x["s"], x["k"], x["e"]) for x in r["base"]]) for r in done)
    assert got == sorted((str(r[0]), base(r[1])) for r in rows)
    for r in done:
        assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}
        assert [tuple(x) for x in r["spans"]] == sorted({tuple(x) for x in r["spans"]})


def test_query_of_spans(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in op4_pii(spark, tiny).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in pii.BASIC] == [sum(1 for x in want if x[1] == k) for k in range(4)]


def test_the_method_adds_spans(spark):
    """Written-out addresses that words speak for are added; look-alikes are not."""
    rng = random.Random(4)
    rows = [(i, f"{odd.prose(i, 20)} please contact or email user{i}@mail{rng.randrange(9)}.com or call +1 (4{i % 90 + 10}) 555-{rng.randrange(1000, 9999)} now", *odd.REST) for i in range(200)]
    rows += [(500 + i, f"{odd.prose(i, 20)} email: name{i} (at) host.com {odd.prose(i, 5)}", *odd.REST) for i in range(80)]
    rows += [(700 + i, f"serial 4{rng.randrange(10**14, 10**15)} total {i}", *odd.REST) for i in range(100)]
    got = {r["doc_id"]: r for r in pii.find_pii(odd.frame(spark, rows)).collect()}
    assert all(len(got[i]["base"]) == 2 for i in range(200))
    for i in range(500, 580):
        at = rows[i - 300][1].index(f"name{i - 500} (at)")
        assert [tuple(x) for x in got[i]["spans"]] == [(at, 0, at + len(f"name{i - 500} (at) host.com"))]
    assert not any(len(got[700 + i]["spans"]) > len(got[700 + i]["base"]) for i in range(100))
    assert pii.find_pii(odd.frame(spark, [])).collect() == []


def test_looser_forms_are_added(spark):
    """Written-out emails, phones without a plus sign and IPv6 addresses that words speak for; not those that words speak against."""
    rng = random.Random(4)
    rows = [(i, f"{odd.prose(i, 20)} please email user{i}@mail{rng.randrange(9)}.com or call +1 (4{i % 90 + 10}) 555-{rng.randrange(1000, 9999)} or connect to host 10.0.{i}.{i % 7}", *odd.REST) for i in range(200)]
    rows += [(200 + i, f"{odd.prose(i, 20)} version 1.2.{i}.{300 + i}", *odd.REST) for i in range(40)]
    forms = [f"email: name{i} (at) host.com" for i in range(80)], [f"phone 415-555-{1000 + i}" for i in range(60)], [f"server 2001:db8:1:2:3:4:5:{i:x}" for i in range(60)]
    against = [f"total 415 555 {1000 + i}" for i in range(40)]
    rows += [(500 + i, f"{odd.prose(i, 20)} {x} {odd.prose(i, 5)}", *odd.REST) for i, x in enumerate(sum(forms, []))]
    rows += [(900 + i, f"{odd.prose(i, 20)} {x}", *odd.REST) for i, x in enumerate(against)]
    got = {r["doc_id"]: r for r in pii.find_pii(odd.frame(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    for i, x in enumerate(sum(forms, [])):
        span = x.split(" ", 1)[1]
        k = pii.KINDS.index("email" if i < 80 else "phone" if i < 140 else "ip")
        start = texts[500 + i].index(span)
        assert got[500 + i]["base"] == [] and [tuple(s) for s in got[500 + i]["spans"]] == [(start, k, start + len(span))]
    assert all(got[i]["spans"] == [] for i in [*range(200, 240), *range(900, 940)])


def test_secrets(spark):
    """Keys and tokens that words speak for are found, long words and checksums are not."""
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"{odd.prose(i, 20)} token = \"{hexa(40)}\" {odd.prose(i, 5)}", *odd.REST) for i in range(60)]
    rows += [(100 + i, f"{odd.prose(i, 20)} {'Wort' * 6}ung{'x' * i} and {'a' * 30}", *odd.REST) for i in range(60)]
    rows += [(200 + i, f"{odd.prose(i, 20)} release sha {'nodigits' * 4}", *odd.REST) for i in range(20)]
    got = {r["doc_id"]: r for r in pii.find_pii(odd.frame(spark, rows)).collect()}
    k = pii.KINDS.index("secret")
    for i in range(60):
        at = rows[i][1].index('"') + 1
        assert [tuple(x) for x in got[i]["spans"]] == [(at, k, at + 40)] and got[i]["base"] == []
    assert all(got[r[0]]["spans"] == [] for r in rows[60:])


def test_plan_has_no_python(spark):
    parts = odd.frame(spark).select(*[pii._candidates(F.coalesce("text", F.lit("")), k).alias(k) for k in pii.KINDS])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


QUESTIONS = [
    (0, "A train leaves Boston at 9 and travels 120 km in 2 hours, then Alice walks 3 km home to Boston. How far did she travel in all?"),
    (1, odd.prose(50, 40)),
    (2, "Short item of exactly seven plain words"),
    (3, None),
    (4, ""),
    (5, "one two"),
]


def test_templates(spark):
    items = spark.createDataFrame(QUESTIONS, "item_id bigint, text string")
    docs = [
        (0, odd.prose(60, 80) + " " + QUESTIONS[0][1] + " " + odd.prose(61, 30)),
        (1, odd.prose(62, 80) + "\nA train leaves Denver at 7 and travels 450 miles in 5 hours, then Maria walks 4 miles home to Denver. How far did she travel in all? " + odd.prose(63, 9)),
        (2, "A train leaves Denver at 7 and travels 450 km in 5 hours, then Maria walks 4 km home to Chicago. How far did she travel in all?"),
        (3, odd.prose(64, 200)),
        (4, QUESTIONS[1][1].upper()),
        (5, odd.prose(65, 30) + " " + QUESTIONS[1][1].replace(" ", "***\n").lower()),
        (6, "Is this a short item of exactly seven plain words, or not?"),
        (9, odd.prose(66, 30) + " " + " ".join(w if k not in (13, 27) else "other words here" for k, w in enumerate(QUESTIONS[1][1].split())) + " " + odd.prose(67, 5)),
        (7, None), (8, ""), (None, QUESTIONS[1][1]), (None, QUESTIONS[1][1]),
    ]
    frame = odd.frame(spark, [(*d, *odd.REST) for d in docs])
    got = sorted((str(r["doc_id"]), r["item_id"], r["verbatim"]) for r in decontaminate.leaks(frame, items).collect())
    assert got == sorted([("0", 0, True), ("1", 0, False), ("4", 1, True), ("5", 1, True), ("6", 2, True), ("9", 1, True), ("None", 1, True), ("None", 1, True)])
    clean = decontaminate.keep_clean(frame, items)
    assert clean.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["2", "3", "7", "8"]


def test_items_with_few_words(spark):
    """Items of numbers, units and names, and items of very few tokens: found where their tokens are, not with other values."""
    rng = random.Random(8)
    numbers = [str(rng.randrange(1000)) for _ in range(40)]
    texts = ["Compute 345 + 678 - 90 * 2 over 7", " ".join(numbers), "a list of Alice Bob Carol Dave Erin Frank Grace Heidi", "7 mod 3", "5 km 6 kg 7 days 8 hours", None, "***"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = [(i, f"{odd.prose(60 + i, 30)} and {x} {odd.prose(70 + i, 9)}") for i, x in enumerate(texts[:5])]
    docs += [
        (10, f"{odd.prose(80, 30)} and compute 346 + 678 - 90 * 2 over 7 {odd.prose(81, 9)}"),
        (11, " ".join(str(int(x) + 1000) for x in numbers)),
        (12, " ".join(w if k % 10 else "none" for k, w in enumerate(numbers))),
        (13, "a list of Alan Bill Chris Dan Ed Fred George Henry"),
        (14, "7 mod 4"), (15, "5 km 6 kg 7 days 9 hours"), (16, "7 mod"), (17, None),
    ]
    frame = odd.frame(spark, [(*d, *odd.REST) for d in docs])
    got = sorted((r["doc_id"], r["item_id"], r["verbatim"], r["covered"]) for r in decontaminate.leaks(frame, items).collect())
    assert got == [(0, 0, True, 7), (1, 1, True, 40), (2, 2, True, 11), (3, 3, True, 3), (4, 4, True, 8), (12, 1, True, 36)]
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(frame, items).collect()) == [10, 11, 13, 14, 15, 16, 17]


@pytest.mark.parametrize("bits", [27, 8])
def test_a_full_bit_table_changes_no_result(spark, monkeypatch, bits):
    """A table of 256 bits, nearly all of them set: every window takes part in the join."""
    monkeypatch.setattr(decontaminate, "TABLE_BITS", bits)
    items = spark.createDataFrame([(i, odd.prose(1000 + i, 30)) for i in range(20)], "item_id bigint, text string")
    docs = odd.frame(spark, [(i, odd.prose(i, 20) + " " + odd.prose(1000 + i, 30), *odd.REST) for i in range(25)])
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    assert [(w[0], w[1], w[3], w[5]) for w in whole] == [(i, i, 30, True) for i in range(20)]
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()) == [20, 21, 22, 23, 24]


def held_by_brute_force(document: str, item: str) -> bool:
    """Whether a document of plain lower-case words holds an item: windows of 8 words that match, gaps of up to 24 between."""
    d, i, best = document.split(), item.split(), set()
    for shift in range(-len(i), len(d)):
        at = [k for k in range(max(0, shift), min(len(d), shift + len(i)) - 7) if d[k : k + 8] == i[k - shift : k - shift + 8]]
        for a in at:
            best |= {k - shift for k in range(a, a + 8)}
        for a, b in zip(at, at[1:], strict=False):
            if b - a <= 24:
                best |= {k - shift for k in range(a, b) if d[k] == i[k - shift]}
    return len(best) >= 30 or 2 * len(best) >= len(i)


def test_leaks_match_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lan", "mer", "nos", "pil", "rut", "sev")]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 70))) for _ in range(25)]
    docs = []
    for k in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        i = items[rng.randrange(25)].split()
        lo = rng.randrange(len(i))
        part = i[lo : lo + rng.randrange(1, len(i) + 1)]
        for _ in range(rng.randrange(6)):
            part[rng.randrange(len(part))] = "edited"
        docs.append(" ".join(w + part + [rng.choice(vocabulary) for _ in range(rng.randrange(9))]))
    frame = odd.frame(spark, [(k, x, *odd.REST) for k, x in enumerate(docs)])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    want = {(k, i) for k, x in enumerate(docs) for i, y in enumerate(items) if held_by_brute_force(x, y)}
    assert got == want and 10 < len(want) < 120


def test_leaks_of_documents_with_text_ids(spark):
    items = spark.createDataFrame([("a", QUESTIONS[1][1])], "item_id string, text string")
    docs = spark.createDataFrame([("x", QUESTIONS[1][1]), ("y", "nothing"), (None, None)], "doc_id string, text string")
    assert [tuple(r)[:2] for r in decontaminate.leaks(docs, items).collect()] == [("x", "a")]
    assert sorted(str(r["doc_id"]) for r in decontaminate.keep_clean(docs, items).collect()) == ["None", "y"]


def test_workers_need_not_have_this_repository(tmp_path):
    """What goes to executors can be unpickled and run where the package cannot be imported."""
    import subprocess
    import sys

    import numpy as np
    from pyspark import cloudpickle

    import palimpsest.llm  # noqa: F401

    class Shared:
        value = np.zeros(1 << 21, np.uint64)

    run = decontaminate._scan(Shared(), [(8, False)], False)
    code = "import pickle, pyarrow as pa; f = pickle.load(open('f', 'rb')); b = pa.RecordBatch.from_pydict({'doc_id': [1], 'text': ['some words ' * 20]}); print(len(list(f(iter([b])))))"
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        (tmp_path / "f").write_bytes(cloudpickle.dumps(run, protocol=5))
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0 and out.stdout.strip() == "0", out.stderr


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(odd.frame(spark), none).collect() == []
    assert decontaminate.keep_clean(odd.frame(spark), none).count() == len(odd.documents())
    items = spark.createDataFrame(QUESTIONS, "item_id bigint, text string")
    assert decontaminate.leaks(odd.frame(spark, []), items).collect() == []


EVENTS = "list string, kind string, value string, action string, at date"


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(n)


@pytest.mark.parametrize("fetched", range(0, 12))
def test_lists_as_of_the_fetch(spark, fetched):
    events = [
        ("block", "domain", "bad.com", "add", day(2)), ("block", "domain", "bad.com", "add", day(3)), ("block", "domain", "bad.com", "remove", day(5)), ("block", "domain", "bad.com", "add", day(8)),
        ("allow", "host", "ok.bad.com", "add", day(1)), ("allow", "host", "ok.bad.com", "remove", day(9)), ("block", "url", "ok.bad.com/x?q=1", "add", day(4)), ("block", "url", "ok.bad.com/x?q=1", "remove", day(4)),
        ("block", "domain", "same.org", "remove", day(6)), ("block", "domain", "same.org", "add", day(6)), ("block", None, "same.org", "add", day(0)), ("allow", "domain", "same.org", "add", day(6)),
    ]
    urls = ["http://bad.com/", "https://user@a.b.BAD.com:80/x#y", "http://ok.bad.com/x?q=1", "http://ok.bad.com/z", "http://notbad.com/", "http://same.org.", None, "no url", "", "http:///x", "http://bad.com/"]
    rows = spark.createDataFrame([(i, u, day(fetched), "clash") for i, u in enumerate(urls)] + [(99, "http://bad.com", None, "clash")], "page_id bigint, url string, fetched date, value string")
    got = {r["page_id"]: (r["host"], r["blocked"], r["kind"]) for r in url_filter.judge(rows, spark.createDataFrame(events, EVENTS)).collect()}
    bad = 2 <= fetched < 5 or fetched >= 8
    assert got[0] == got[10] == ("bad.com", bad, "domain" if bad else None)
    assert got[1] == ("a.b.bad.com", bad, "domain" if bad else None)
    listed = 1 <= fetched < 9
    page = fetched >= 4  # removed and added on one day: the addition counts
    assert got[2][1:] == ((True, "url") if page else (False, "host") if listed else (bad, "domain" if bad else None))
    assert got[3][1:] == ((False, "host") if listed else (bad, "domain" if bad else None))
    assert got[4][1:] == (False, None)
    assert got[5] == ("same.org", fetched >= 6, "domain" if fetched >= 6 else None)
    assert all(got[i] == (None, False, None) for i in (6, 7, 8, 9))
    assert got[99] == ("bad.com", False, None)


def test_empty_lists_and_captures(spark):
    rows = spark.createDataFrame([], "page_id bigint, url string, fetched date")
    events = spark.createDataFrame([], EVENTS)
    assert url_filter.judge(rows, events).collect() == []
