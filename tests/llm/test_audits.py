"""Licence scans, source divergence and filter interactions against brute force, and on awkward rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import divergence, interactions, licenses, queries

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    """With extra columns whose names operators use themselves."""
    return spark.createDataFrame(rows, schema).select("*", *(F.lit(1).alias(c) for c in ("term", "count", "id", "part", "mask", "words", "length", "spans", "rank", "p", "n")))


ODD = [
    (1, None, None, None), (2, "", "", ""), (3, " \n\t ", "en", None), (4, "Same words here", "en", "a"), (5, "Same words here", "en", "b"), (5, "Same words here", "en", "b"), (None, "Same words here", None, "b"),
    (6, "x" * 30_000, "en", "a"), (7, "The MIT License. MIT   license, GNU general-public license " * 4_000, "en", "a"), (8, "É中文 😀 ünï code words", "de", "ü"), (9, None, "de", "ü"),
]


# ---------------------------------------------------------------- licences


def model_matches(templates, words, least):
    """Every maximal run of words that some template holds, by trying all substrings."""
    held = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    out, before = [], 0
    for end in range(1, len(words) + 1):
        size = next((n for n in range(min(end, before + 1), 0, -1) if tuple(words[end - n : end]) in held), 0)
        if before >= least and size <= before:
            out.append((end - 1, before))
        before = size
    return out + ([(len(words), before)] if before >= least else [])


def test_automaton_matches_brute_force():
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(60):
        templates = [[rng.choice("abcd") for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        phrases = [[rng.choice("abcd") for _ in range(rng.randrange(1, 4))] for _ in range(2)]
        words = [rng.choice("abcdz") for _ in range(120)]
        made = licenses.Automaton(tuple(("t", " ".join(t)) for t in templates), tuple(("".join(x for x in " ".join(p)), "p") for p in phrases))
        found = licenses.walk(made, pa.scalar(" ".join(words)), 2)
        assert [m[:2] for m in found.matches] == model_matches(templates + phrases, words, 2)
        places = sorted((k, a) for k, p in enumerate(phrases) for a in range(len(words)) if words[a : a + len(p)] == p)
        assert sorted(found.phrases) == places and found.words == 120
        for end, size, state in found.matches:
            assert sorted(made.places[state]) == sorted((t, e) for t, text in enumerate(templates) for e in range(size, len(text) + 1) if text[e - size : e] == words[end - size : end])


def base_of(text):
    words = re.findall(WORD, low(text))
    hits = sorted((a, label) for phrase, label in licenses.PHRASES for a in range(len(words)) if words[a : a + len(phrase.split())] == phrase.split())
    return len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({b for _, b in hits}))


def test_license_base_columns(spark):
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall() + ODD
    got = licenses.report(licenses.scan(frame(spark, rows))).collect()
    base = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert Counter(map(base, got)) == Counter((d, *base_of(t)) for d, t, _, _ in rows)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] == 0) == (r["labels"] == "" and r["n_base"] == 0) or r["score"] < 0.6


def test_license_spans(spark):
    mit, gpl = licenses.TEMPLATES[0][1], licenses.TEMPLATES[8][1]
    changed = mit.split()
    changed[12:14] = ["some", "other", "words"]
    rows = [
        (1, f"Opening words. {mit}\nclosing words", "en", "a"), (2, " ".join(changed), "en", "a"), (3, "Permission is hereby granted", "en", "a"),
        (4, f"{mit} between {' more' * 40} {gpl}", "en", "a"), (5, f"{mit} {mit}", "en", "a"), (6, "any person to deal with the use of the software", "en", "a"),
        (7, " ".join(reversed(mit.split())), "en", "a"), (8, "It is Licensed under CC BY-NC 4.0!", "en", "a"), (9, mit.replace(" ", "\n * "), "en", "a"),
    ]
    scanned = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    got = {r["doc_id"]: r for r in licenses.report(licenses.scan(frame(spark, rows))).collect()}
    size = len(re.findall(WORD, mit))
    whole = [(s["label"], s["start"], s["end"], s["covered"]) for s in scanned[1]["spans"] if s["covered"] == 1.0]
    assert whole == [("mit", 2, 2 + size, 1.0)]
    assert got[2]["labels"] == "mit" and 0.9 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.2
    assert got[4]["labels"] == "gpl,mit" and got[4]["base_labels"] == "gpl"
    assert len([s for s in scanned[5]["spans"] if s["covered"] == 1.0]) == 2
    assert got[6]["labels"] == got[7]["labels"] == "" and got[8]["labels"] == "cc-by-nc" and got[9]["labels"] == "mit"


def test_license_streams_in_pieces():
    import pyarrow as pa

    from tracewright.llm.common import byte_table, pieces

    table = byte_table(lambda b: 97 <= b <= 122 or 65 <= b <= 90)
    text = "Über alles 中文 words and MORE words " * 50 + "w" * 300
    for size in (1, 2, 7, 64, 1 << 20):
        assert [w.decode() for part in pieces(pa.scalar(text), table, size) for w in part] == re.findall(TERM, low(text))
    assert list(pieces(pa.scalar(None, pa.string()), table)) == [] == list(pieces(pa.scalar(""), table))


# ---------------------------------------------------------------- divergence


def model_divergence(rows, min_docs, most=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        terms = re.findall(TERM, low(text))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        p = {s: {t: share(of[s][t], sum(of[s].values())) for t in kept} for s in sources}
        total = {t: sum(of[s][t] for s in sources) for t in kept}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, len(pairs)), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("min_docs", [1, 2, 1_000])
def test_divergence_of_odd_rows(spark, min_docs):
    got = rows_of(divergence.divergence(frame(spark, ODD), min_docs=min_docs))
    assert len(got) == len(set(got)) and set(got) == model_divergence(ODD, min_docs)


def test_divergence_of_documents(spark):
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()
    assert set(rows_of(divergence.divergence(frame(spark, rows), min_docs=4, most=7))) == model_divergence(rows, 4, 7)


def test_divergence_counts_in_parts(spark):
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()
    few, many = (divergence.term_counts(frame(spark, rows).na.fill(""), most_keys=n) for n in (500, 1 << 30))
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty() and not many.isEmpty()


def test_divergence_shares_are_exact(spark):
    counts = [0, 1, 10**9 + 7, 10**12 + 3]
    df = spark.createDataFrame([(c, 7 * 10**12 + 11, 12_345) for c in counts], "count long, n long, v long")
    assert [r[0] for r in df.select(divergence._share("count", "n", "v", 5)).collect()] == [1 + 10**9 * (c + 5) // (7 * 10**12 + 11 + 5 * 12_345) for c in counts]


# ---------------------------------------------------------------- interactions


def model_masks(rows, labels):
    least, out = {}, defaultdict(Counter)
    for d, text, _, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, text, _, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        mine = [x for x in labels if x[0] == d and d is not None]
        out[source or ""][frozenset(k for k, v in failed.items() if v), any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)] += 1
    return out


def model_audit(rows, labels):
    out, worth = {}, Counter()
    for part, masks in model_masks(rows, labels).items():
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                seen, now = set(order[: step - 1]), [0] * 6
                for (failed, good, toxic), n in masks.items():
                    hit, gone = letter in failed, bool(failed & seen)
                    for k, yes in enumerate((not hit and not gone, hit and not gone, hit and gone, failed == {letter}, hit and not gone and good, hit and not gone and toxic)):
                        now[k] += n * yes
                worth[part, letter] += now[1]
                out[part, "".join(order), step] = now
    return {k: (*v, worth[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in df.collect()}


LABELS = [(1, 1, 0), (4, 1, None), (5, 0, 1), (5, 1, 0), (8, None, None), (None, 1, 1), (99, 1, 1)]


def test_interactions_of_odd_rows(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = interactions.audit(frame(spark, ODD), labels)
    assert got.count() == 600 * len({r[3] or "" for r in ODD}) and audited(got) == model_audit(ODD, LABELS)


def test_interactions_of_documents(spark):
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()
    got = audited(interactions.audit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    assert got == model_audit(rows, labels)


def test_refinement_by_late_blocks(spark):
    """Texts of one length that differ in their first, a middle or their last character only, and copies of each."""
    base, rows = "ab cd " * 1_500, []
    for k in (0, 255, 256, 1_279, 1_280, 5_375, 5_376, 8_999):
        text = base[:k] + "#" + base[k + 1 :]
        rows += [(len(rows) * 7 % 31, text, "en", "a") for _ in range(3)]
    rows += [(100 + k, base, "en", "b") for k in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, source string").select("id", "text")
    got = sorted(r["id"] for r in interactions.repeated(docs, interactions.keyed(docs)).collect())
    least = {}
    for d, text, *_ in rows:
        least[text] = min(d, least.get(text, d))
    assert got == sorted(d for d, text, *_ in rows if d > least[text])


def test_hash_collisions_fall_to_the_texts(spark, monkeypatch):
    monkeypatch.setattr(interactions, "_blocks", lambda text: [F.lit(0).cast("long") for _ in interactions.KEY[1:]])
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "bb"), (6, "d")], "id long, text string")
    assert sorted(r["id"] for r in interactions.repeated(docs, interactions.keyed(docs)).collect()) == [3, 5]


def test_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licenses.report(licenses.scan(none)).isEmpty() and divergence.divergence(none).isEmpty() and interactions.audit(none, labels).isEmpty()


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_filter_interactions"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())
