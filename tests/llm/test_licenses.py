"""License scans against brute force."""

import random
import re

from siftwork.llm import licenses


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text):
    words = words_of(text)
    places, base = [], set()
    for label, phrase in licenses.PHRASES.items():
        run = phrase.split()
        here = [i for i in range(len(words)) if words[i:i + len(run)] == run]
        places += here
        base |= {label} if here else set()
    labels, best = set(base), 0.0
    for label, template in licenses.TEMPLATES:
        run = words_of(template)
        reach = next(r for r in licenses.REACHES if len(run) <= r)
        for k in range(max(-(-len(words) // reach) - 1, 1)):
            block = set(words[k * reach:(k + 2) * reach])
            share = len(set(run) & block)
            if 100 * share >= licenses.THRESHOLD * len(set(run)):
                labels.add(label)
                best = max(best, share / len(set(run)))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1.0 if places else best)


def scanned(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return licenses.scan_licenses(docs, **options)


def as_tuples(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in df.collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    filler = ["the", "of", "license", "under", "is", "this", "work", "software", "größe", "version", "2", "0", "by", "cc", "and", "weiß"]
    pieces = [t for _, t in licenses.TEMPLATES] + list(licenses.PHRASES.values()) + ["CC\nBY", "all  rights, reserved.", "General-Public License"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            notice = rng.choice(pieces).split(" ")
            for _ in range(rng.randrange(5)):  # notices with words lost, changed and moved apart
                at = rng.randrange(len(notice))
                notice[at:at + 1] = rng.choice([[], ["other"], [notice[at], "new"]])
                notice = notice or ["x"]
            parts += [" ".join(rng.choice(filler) for _ in range(rng.randrange(90))), " ".join(notice)]
        rows.append((i, rng.choice(["\n", " ", ". "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, " ,.;"), (None, "All rights reserved"), (None, "cc by cc by cc by"), (1003, "cc by-cc by"),
             (1003, "cc by-cc by"), (1003, "acc by"), (1004, "word " * 30_000 + licenses.TEMPLATES[0][1] + " word" * 30_000 + " CC BY")]
    expected = sorted(((i is None, i or 0, *brute(t)) for i, t in rows), key=repr)
    assert as_tuples(scanned(spark, rows)) == expected
    assert sum(1 for e in expected if e[7]) > 40 and sum(1 for e in expected if not e[7]) > 10


def test_clean_words_get_no_label(spark):
    rows = [(1, "The license of the work is under review, the software is free to use and this version is the last."), (2, "Reserved rights: all.")]
    assert {(r.labels, r.score, r.n_base) for r in scanned(spark, rows).collect()} == {("", 0.0, 0)}


def test_empty_tables_and_other_columns(spark):
    assert scanned(spark, []).collect() == []
    docs = spark.createDataFrame([(1, "All rights reserved", "x", 3)], "n_words long, text string, labels string, _id int")
    found = licenses.scan_licenses(docs, id_col="n_words", text_col="text").collect()
    assert [tuple(r) for r in found] == [(1, 3, 1, 0, 0, "reserved", "reserved", 1.0)]


def test_plan_is_native(spark, sf_dir):
    from siftwork.llm.queries import QUERIES

    plan = QUERIES["op13_license_scans"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|CartesianProduct|NestedLoop", plan)
