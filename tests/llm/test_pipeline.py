"""The pipeline's stages in order, each on what the one before kept."""

import re
from collections import Counter

import pyarrow as pa
from test_operators import components, distance, low, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import decontaminate, neardup, toxicity
from tracewright.llm.common import written
from tracewright.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= last, name
        last = docs.count()
    assert neardup.near_duplicates(docs).filter("not kept").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.report(decontaminate.contamination(docs, bench)).filter("contaminated").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == last


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "packing"]


def model_lines(docs):
    """Each document's text without lines that repeat an earlier one, exactly or within the edits of their length."""
    blanks, seen, longer, out = " \t\n\x0b\x0c\r", set(), [], {}
    for d in sorted(docs):
        rows = (docs[d] or "").split("\n")
        kept = []
        for row in rows:
            line = row.strip(blanks)
            if line in seen:
                continue
            near = False
            if len(line) >= 24:
                letters = Counter(line)
                for other, has in longer:
                    edits = 4 if min(len(line), len(other)) >= 96 else 2 if min(len(line), len(other)) >= 48 else 1
                    if abs(len(line) - len(other)) <= edits and sum(((letters - has) + (has - letters)).values()) <= 2 * edits and distance(line, other) <= edits:
                        near = True
                longer.append((line, letters))
            if line:
                seen.add(line)
            if not near:
                kept.append(row)
        if len(kept) == len(rows) or any(row.strip(blanks) for row in kept):
            out[d] = "\n".join(kept)
    return out


def test_every_stage_against_plain_python(spark):
    """What each stage keeps of a fixture, ids and texts, given the learned grammar and the tokenizer."""
    source = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(source, key=lambda d: len(source[d]["text"] or ""))[:90]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = max((source[d]["text"] for d in ids), key=len)
    planted = {9001: long + " more", 9002: "before it " + bench[0] + " and after", 9003: "a line that others nearly repeat, but for one word\nown words of this one", 9004: "a line that others nearly repeat, but for one wort\nand others here"}
    rows = [source[d] | {"doc_id": d} for d in ids] + [source[ids[0]] | {"doc_id": d, "text": t, "n_chars": len(t)} for d, t in planted.items()]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)

    have = texts(docs)
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip(have, toxicity._probabilities(model, pa.array(list(have.values()), pa.string()), {}).tolist()))
    docs = written(stages["toxicity"](spark, docs, SF))
    assert texts(docs) == {d: t for d, t in have.items() if score[d] < 0.3} != have

    want = model_lines(texts(docs))
    docs = written(stages["line dedup"](spark, docs, SF))
    assert texts(docs) == want and want[9004] == "and others here"
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None and r["doc_id"] in planted)

    root = components({d: shingles(t, 5) for d, t in want.items()})
    docs = written(stages["near-dedup"](spark, docs, SF))
    assert texts(docs) == {d: t for d, t in want.items() if root[d] == d}

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = {tuple(w[k : k + min(10, len(w))]) for w in map(words, bench) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = {d: t for d, t in texts(docs).items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}
    docs = written(stages["decontamination"](spark, docs, SF))
    assert texts(docs) == clean and 9002 not in clean

    coder = Tokenizer.from_file(tokenizer_path())
    length = {d: len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    pieces, filled = Counter(), Counter()
    for r in stages["packing"](spark, docs, SF).collect():
        pieces[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
        assert r["doc_tokens"] == length[r["doc_id"]]
    assert pieces == length and max(filled.values()) <= 2048
