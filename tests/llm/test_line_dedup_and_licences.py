import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weirgauge.llm import licences, line_dedup
from weirgauge.llm.licences import RULES, SENTENCES, scan_licences
from weirgauge.llm.line_dedup import drop_site_lines, host_of, page_lines, text_lines


CLASH = ("clash",) * 5


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), defaultdict(Counter)
    for host, lines in rows:
        pages[host] += 1
        seen[host].update(set(lines))
    return [[x for x in lines if host is None or not (seen[host][x] >= least and seen[host][x] > ratio * pages[host])]
            for host, lines in rows]


@pytest.mark.parametrize("ratio,least", [(0.05, 5), (0.3, 2), (0.0, 1), (1.0, 1)])
def test_site_lines(spark, ratio, least):
    rng = random.Random(2)
    common = [f"line {i}" for i in range(30)]
    rows = []
    for i in range(300):
        host = rng.choice(["hot"] * 6 + ["b", "c", None])
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own {i} {j}" for j in range(rng.randrange(0, 9))]
        rows.append((i if i % 50 else None, host, "\n".join(lines), *CLASH))
    rows += rows[:3] + [(999, "hot", None, *CLASH), (998, "solo", "only line", *CLASH), (997, "hot", "long " * 30_000, *CLASH)]
    pages = spark.createDataFrame(rows, "id long, host string, text string, _lines string, salt string, row string, lines string, `drop` string")
    got = drop_site_lines(pages, F.col("host"), text_lines(F.col("text")), ratio, least).collect()
    split = [(r[1], [x for x in (r[2] or "").split("\n") if x.strip(" ")]) for r in rows]
    want = sorted((r[0], r[1], len(s[1]), k) for r, s, k in zip(rows, split, brute_lines(split, ratio, least)) if r[0] is not None)
    assert sorted((r["id"], r["host"], r["n_lines"], r["kept_lines"]) for r in got if r["id"] is not None) == want
    assert all(r["_lines"] == r["salt"] == r["row"] == r["lines"] == r["drop"] == "clash" for r in got)
    assert len(got) == len(rows) and all(r["n_lines"] - r["n_dropped"] == len(r["kept_lines"]) for r in got)
    assert drop_site_lines(pages.limit(0), F.col("host"), text_lines(F.col("text"))).count() == 0


def test_hosts_and_page_lines(spark):
    frame = spark.createDataFrame([
        ("HTTP://A.b:8/c?d", "<html><script>x='</p>'</script><p>A &amp;lt; <b>b</b>\n c</p><!-- <p>z --><ul><li>1<li>2</ul>"),
        ("https://h", ""), ("nope", None), (None, "  plain ")], "url string, html string")
    got = frame.select(host_of(F.col("url")).alias("h"), page_lines(F.col("html")).alias("l")).collect()
    assert [tuple(r) for r in got] == [
        ("a.b:8", ["A &lt; b c", "1", "2"]), ("h", []), (None, []), (None, ["plain"])]


def brute_licences(text):
    """Walk the identifiers and strike out the rules' sequences."""
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = re.split(r"[.!?;:]+(?:[ \t\n\v\f\r]+|\Z)|\n", lowered)
    by_sentence = {v: k for k, v in SENTENCES.items()}
    names = [by_sentence.get(re.sub("[^a-z0-9]+", " ", p).strip()) for p in parts]
    ids = [n for n in names if n]
    left, hits = list(ids), set()
    for licence, rule in RULES:
        at = 0
        while at + len(rule) <= len(left):
            if tuple(left[at:at + len(rule)]) == rule:
                left[at:at + len(rule)] = [None]
                hits.add(licence)
            at += 1
    return (",".join(sorted(hits)), ",".join(ids), len(ids), next(i for i, n in enumerate(names) if n)) if ids else None


def test_licences(make_docs, odd_rows):
    rng = random.Random(4)
    names = list(SENTENCES)
    rows = [tuple(r) for r in odd_rows]
    for i in range(250):
        parts = [rng.choice(["Some text.", "More\n", "x; y:", ""]) for _ in range(rng.randrange(0, 5))]
        for _ in range(rng.randrange(0, 3)):
            rule = rng.choice(RULES)[1] if rng.random() < 0.6 else [rng.choice(names)]
            for name in rule:
                sentence = SENTENCES[name].replace(" ", rng.choice([" ", "  ", ", "])).capitalize()
                parts.append(sentence + rng.choice([". ", ".\n", "\n", "! "]) + rng.choice(["", "", "Unknown words. "]))
        rows.append((100 + i, " ".join(parts), "en", "a"))
    rows += [(900, "Licensed under the Apache License, Version 2.0.", "en", "a"), (901, "Licensed under CC BY-NC 4.0.", "en", "a"),
             (902, "not Released under the MIT License.", "en", "a"), (None, "Released under the MIT License.", "en", "a")]
    docs = make_docs(rows)
    want = [(r[0], *found) for r in rows if (found := brute_licences(r[1]))]
    got = [tuple(r) for r in scan_licences(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 80
    assert scan_licences(docs.limit(0)).count() == 0


def test_tables_are_consistent():
    assert len(set(SENTENCES.values())) == len(SENTENCES)
    lengths = [len(ids) for _, ids in RULES]
    assert lengths == sorted(lengths, reverse=True) and all(i in SENTENCES for _, ids in RULES for i in ids)
    assert "documents" in licences.sql() and "pages" in line_dedup.sql()
