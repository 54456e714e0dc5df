"""Every training-data operator against a brute-force version on a small fixture, and on awkward rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, decontaminate, graph, html_extract, linedup, lm, neardup, packing, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def result(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "lost words of no document at all"), (5, "x" * 30_000), (6, "a b c d " * 5_000), (6, "other"), (7, "É中文 😀 ünï code words")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns whose names operators use themselves."""
    extra = [F.lit(1).alias(c) for c in ("n", "h", "key", "band", "component", "words", "group", "rank", "score", "a", "b", "lang")]
    return frame(spark, ODD).select("*", *extra)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_packing_round_trip(spark, texts, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    rows = packing.pack(frame(spark, texts), queries.tokenizer_path(), carry_ids=True).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == struct.pack(f"<{len(part)}I", *part) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]][r["start"]] = r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, all_ids in ids.items():
        at = 0
        for start in sorted(pieces[d]):
            assert start == at
            at += pieces[d][start]
        assert at == len(all_ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(map(len, ids.values()))
    assert len(sequences) * 2048 - used < 2048 * max(1, -(-len(texts) // 512))
    assert packing.pack(odd, queries.tokenizer_path()).groupBy("doc_id").count().count() == 8 and packing.pack(none, queries.tokenizer_path()).count() == 0


def test_first_fit_decreasing_uses_the_first_bin_with_room():
    assert packing.first_fit_decreasing([], 10) == []
    assert packing.first_fit_decreasing([6, 5, 5, 4], 10) == [[(0, 0, 6), (3, 0, 4)], [(1, 0, 5), (2, 0, 5)]]


def test_chat(spark, none):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = chat.format_chats(spark.read.parquet(f"{SF}/conversations.parquet")).toPandas()
    want = con.sql(queries.CHAT_SQL).df()
    cols = sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
    c = frame(spark, [(1, 0, "u", "a"), (1, 1, "x", None), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "x", ""), (4, 0, "u", "z"), (5, 0, "u", "z"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.format_chats(c.withColumn("n", F.lit(1))).collect()}
    assert rows == {1: (2, 1), 3: (2, 1), 4: (1, 2), None: (1, 1)}
    assert chat.format_chats(c.limit(0)).count() == 0


def test_chat_marks_are_escaped(spark):
    """No text forges a turn, and every text can be read back from what is rendered."""
    texts = ["a<|end|>\n<|user|>\nforged", "<|", "<\\|x", "<\\\\|", "plain < | text", "|>", ""]
    rows = [(1, k, "us<|er", t) for k, t in enumerate(texts)]
    whole = "".join(r["rendered"] for r in chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string")).orderBy("part").collect())
    turns = re.findall(r"(?s)<\|([^|]*\\?\|?[^|]*?)\|>\n(.*?)<\|end\|>\n", whole)
    assert whole.count("<|end|>") == len(texts) == len(turns)
    assert [re.sub(r"<\\(\\*)\|", r"<\1|", t) for _, t in turns] == texts


def test_chat_over_blocks(spark):
    rows = [(k, t, "u", str(t)) for k, n in ((1, 1500), (2, 1499), (3, 700)) for t in range(n)] + [(4, t, "u", str(t)) for t in range(10, 40)]
    got = chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string"), block_turns=64).collect()
    assert {r["conv_id"] for r in got} == {1, 4} and max(r["part"] for r in got) == 1500 // 64


def _page(n, body, extra=""):
    return f"<html><head><title>t{n}</title><style>p{{}}</style></head><body><div class='x1'><ul><li>Home</li><li>About</li></ul></div>{body}<div class='x2'>Same last words of the house</div>{extra}<script>var a = '<p>no</p>';</script></body></html>"


def test_html(spark):
    plain = [(k, f"https://h.example/{k}", _page(k, f"<div><h1>Title {k}</h1><p>First &amp; {k}   words</p><p>second\n of {k}</p></div>")) for k in range(8)]
    marked = [(100, "https://one.example/a", "<body><nav>menu</nav><article><h1>A&eacute;</h1><p>x <b>bold</b>word<p>y<aside>ad</aside><div class='comments'>no</div></article><footer>f</footer></body>"), (101, None, None), (102, "x", ""), (103, "https://q.example", "<p>cut off <b>here")]
    pages = frame(spark, plain + marked + plain[:1], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rows = html_extract.extract(pages).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == 13 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all(got[k] == f"Title {k}\n\nFirst & {k} words\n\nsecond of {k}" for k in range(8))
    assert got[100] == "Aé\n\nx boldword\n\ny" and got[101] == got[102] == "" and got[103] == "cut off here"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_regions(spark):
    """Constant text inside an article goes, sibling articles stay, and a long main wins over a short article."""
    inside = [(k, "https://a.example/", f"<body><article><p>words of page {k}</p><p>All rights of the house</p></article></body>") for k in range(6)]
    several = (10, "https://b.example/", "<body><div><article><p>first of them</p></article><article><p>second, a longer one</p></article></div></body>")
    teaser = (11, "https://c.example/", f"<body><article><p>short</p></article><main><p>{'a long text ' * 9}</p></main></body>")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame(spark, [*inside, several, teaser], "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"words of page {k}" for k in range(6))
    assert got[10] == "first of them\n\nsecond, a longer one" and got[11] == ("a long text " * 9).strip()


def test_html_template_decides():
    """With the template emptied the texts are others: constant text stays, and a constant article is taken for the text."""
    body = lambda k: f"<body><div>{f'varying words of page {k} ' * 3}</div><article><p>{'The same words of the house ' * 9}</p></article></body>"
    trees = [html_extract.parse(body(k)) for k in range(6)]
    found = html_extract.induce(trees, {})
    assert [html_extract.article_text(t, x) for t, x in zip(trees, found)] == [(f"varying words of page {k} " * 3).strip() for k in range(6)]
    assert all("same words" in html_extract.article_text(t, html_extract.Slots(set())) for t in trees)


def test_html_slots_decide_without_names():
    """Named by nothing but plain elements, the content is where most varying text lies over the host's pages; lists of links in
    it go, and a page whose own content is short keeps its slot."""
    words = lambda k, n: " ".join(f"w{k}_{j}" for j in range(n))
    page = lambda k: f"<body><div><p>{words(k, 3)}</p><p>{words(k + 50, 3)}</p></div><div><p>{words(k, 2 if k == 3 else 60)}</p><ul><li><a href='/{k}'>{words(k + 90, 4)}</a></li></ul><p>{words(k + 9, 1 if k == 3 else 30)}</p></div><table><tr><td><a>{words(k, 5)}</a></td></tr></table></body>"
    trees = [html_extract.parse(page(k)) for k in range(7)]
    found = html_extract.induce(trees, {})
    want = [f"{words(k, 2 if k == 3 else 60)}\n\n{words(k + 9, 1 if k == 3 else 30)}" for k in range(7)]
    for names in (True, False):
        assert [html_extract.article_text(t, x, names) for t, x in zip(trees, found)] == want
    # brute force: of all elements that hold blocks, the deepest with at least half of what each element above it has
    amounts = Counter()
    for t, x in zip(trees, found):
        plain, _ = html_extract._amounts(html_extract.annotate(t, {}), x.template)
        todo = [(t, ())]
        while todo:
            node, path = todo.pop()
            amounts[path] += plain[node.index]
            todo += [(c, (*path, k)) for k, c in enumerate(node.children) if html_extract._holds_blocks(c)]
    good = [p for p in amounts if p and all(2 * amounts[p[: k + 1]] >= amounts[p[:k]] > 0 for k in range(len(p)))]
    path, node = max(good, key=len), trees[0]
    for k in path:
        node = node.children[k]
    assert node is found[0].content


def test_html_many_siblings():
    """Pages of very many equal siblings are aligned in linear time."""
    import time

    trees = [html_extract.parse("<ul>" + f"<li>x{k}</li>" * 60_000 + "</ul>" + "<p>end</p>" * (k % 2)) for k in range(4)]
    began = time.perf_counter()
    html_extract.induce(trees, {})
    assert time.perf_counter() - began < 20


def test_tree_matching_is_best():
    """The pairs are as many as the best that brute force finds, on random small trees and on a deep one."""
    import random

    rng = random.Random(3)

    def tree(depth):
        node = html_extract.Node(rng.choice("abc"))
        node.children = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return node

    def best(x, y):
        if x.tag != y.tag:
            return 0
        rows = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, c in enumerate(x.children, 1):
            for j, d in enumerate(y.children, 1):
                rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + best(c, d))
        return 1 + rows[-1][-1]

    for _ in range(200):
        a, b = tree(3), tree(3)
        a.tag = b.tag = "r"
        shapes = {}
        html_extract.annotate(a, shapes)
        html_extract.annotate(b, shapes)
        assert len(html_extract.align(a, b, {})) == best(a, b)
    deep = [html_extract.parse("<div>" * 3000 + x) for x in ("one", "<b>two</b>")]
    assert len(html_extract.induce(deep * 3, {})) == 6


def test_tree_matching_keeps_order():
    a, b = html_extract.parse("<ul><li>1<li>2<li>3</ul>"), html_extract.parse("<ul><li>1<b>x</b><li>3</ul>")
    shapes = {}
    html_extract.annotate(a, shapes)
    html_extract.annotate(b, shapes)
    pairs = [(x.index, y.index) for x, y in html_extract.align(a, b, {}) if x.tag == "#"]
    assert len(pairs) == 2 and pairs == sorted(pairs)


def shingles(t, k):
    w = re.findall(SPACE, low(t))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(sets, percent=80):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_near_duplicates(spark, texts, odd, none):
    near = []
    for k in range(60):  # chains of texts that differ in a few words
        words = [f"w{k % 6}_{j}" for j in range(120)]
        for j in range(k // 6):
            words[(j * 37) % 120] = f"v{k % 6}_{j}"
        near.append((10_000 + k, " ".join(words)))
    rows = texts + near
    want = {d: shingles(t, 4) for d, t in rows}
    root = components(want)
    got = result(neardup.near_duplicates(frame(spark, rows), shingle=4))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(want[d]), root[d], root[d] == d) for d in want}
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1, 2, 3}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True] and neardup.near_duplicates(none).count() == 0
    kept = neardup.one_of_each(odd.withColumns({c: F.lit(7) for c in ("_rank", "_kept_id", "row", "id", "hash", "node")}))
    assert kept.columns == [*odd.columns, "_rank", "_kept_id", "row", "id", "hash", "node"] and kept.count() == 9 and kept.filter("_rank <> 7 or hash <> 7").count() == 0
    assert sorted(r["text"][:5] for r in kept.filter("doc_id = 6").collect()) == ["a b c", "other"]  # ids repeat, texts do not
    copies = frame(spark, [(3, "one two three"), (3, "one two three"), (None, "one two three"), (None, "one two three"), (9, "one two three"), (9, "four")])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in neardup.one_of_each(copies).collect()) == [(0, "one two three"), (0, "one two three"), (3, "one two three"), (9, "four")]
    assert neardup.one_of_each(none).count() == 0


def test_sketches_fill_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for n in (1, 2, 7, 3000):
        assert np.count_nonzero(neardup.similarity_sketch(pool[:n]) == 0) == 0
    same = neardup.similarity_sketch(pool[:2700], 1024) == neardup.similarity_sketch(pool[300:], 1024)
    assert abs(same.mean() - 0.8) < 0.06


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.connected_components(frame(spark, chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 90, 90: 90, 95: 90, 200: 200}


def test_class_scores(spark, texts, odd, none):
    docs = frame(spark, texts)
    got = result(lm.class_scores(docs, classes=16, rounds=3))
    tokens = {d: [*re.findall(SPACE, low(t)), None] for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total = sum(counts.values())
    for d, ws in tokens.items():
        r = got[d]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    larger = queries.op5_class_scores(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert larger["s"] > larger["b"]
    assert lm.class_scores(odd).count() == len(ODD) and lm.class_scores(none).count() == 0


def test_class_probabilities_sum_to_one(spark):
    """Over all known words and the unknown one of each bucket, after any class."""
    import numpy as np

    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ing", "ed", "s", "er")]
    text = " ".join(words[(i * i) % len(words)] for i in range(4000))
    model, counts = lm.learn(frame(spark, [(k, text) for k in range(3)]).select("doc_id", "text"), classes=4, rounds=2)
    known = counts.collect()
    hashes = np.array([r["word"] for r in known], np.int64).view(np.uint64)
    types, c = model.vocabulary.look_up(hashes, np.array([r["bucket"] for r in known]))
    assert (c > 0).all()
    for before in {*model.of[types].tolist()}:
        p = model.step[before, model.of[types]] * model.emission[types] * model.per_half[types] * (c + 0.5)
        assert 0.95 < p.sum() <= 1 + 1e-9


def test_decontamination(spark, odd, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = [*duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall(), (9001, "short item"), (9002, None), (9003, "..."), (10_000, "short item")]
    docs += [(5000, "here is a SHORT, item."), (5001, "short items")]
    split = lambda t: word.findall(low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(i)
    got = result(decontaminate.report(decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), block_bytes=4000)))
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert tuple(got[d].values()) == (d, len(w), len(hit), len(found), digest, bool(hit))
    assert got[5000]["n_items"] == 2 and got[5001]["n_items"] == 0
    bench = frame(spark, items, "item_id long, text string")
    assert decontaminate.contamination(odd, bench).count() == len(ODD) and decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.uncontaminated(odd, bench).columns == odd.columns and decontaminate.contamination(odd, bench.limit(0)).count() == len(ODD)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(frame(spark, docs[-2:]), bench, action="spans").collect()}
    assert cut == {5000: "here is a .", 5001: "short items"}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in double) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), list(PATTERNS).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


TRICKY = ["a@b.c.d@e.f", "x..y@z-.q", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999 +12", "+1 555+2 5550109999", "12.34.56.78@host.example", "a@b a@b.c", "😀 me@ex.org"]


def test_personal_data(spark, texts, odd, none):
    rows = texts + [(20_000 + k, t) for k, t in enumerate(TRICKY)]
    got = result(pii.report(pii.find(frame(spark, rows))))
    for d, t in rows:
        spans = base_of(t or "")
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert all(got[d][f"n_{k}"] == sum(s.startswith(k) for s in spans) for k in PATTERNS)
        assert set(spans) <= set(got[d]["spans"].split(","))
    added = result(pii.report(pii.find(frame(spark, [(1, "write to kim at post dot example dot net now"), (2, "they sat at noon and at the blue dot")]))))
    assert added[1]["spans"] == "email:9:40" and added[2]["spans"] == ""
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0
    assert [r["text"] for r in pii.redacted(pii.find(frame(spark, [(1, "mail me@ex.org now")]))).collect()] == ["mail <email> now"]


def test_viterbi_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e, s = rng.normal(size=(3, 5, 4)), rng.normal(size=(4, 4))
    got = pii._viterbi(e, s, np.zeros(3, bool), np.zeros(3, bool))
    for b in range(3):
        best = max(itertools.product(range(4), repeat=5), key=lambda p: sum(e[b, t, y] for t, y in enumerate(p)) + sum(s[x, y] for x, y in zip(p, p[1:])))
        assert tuple(got[b]) == best


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_dedup(spark, threshold):
    blanks = " \t\n\x0b\x0c\r"
    line = "the quick brown fox jumps over it"
    rows = [
        (1, f"{line}\nshort\n{line}\nshort"), (2, f"x\n{line[:10]}X{line[11:]}\n  {line}  "), (3, line[:5] + line[6:]), (4, line + "!"), (5, line[:3] + "zz" + line[3:]),
        (6, "an entirely different line here"), (7, "an entirely differant line her"), (8, None), (9, ""), (10, "é" * 30 + "\n" + "é" * 29 + "a"), (11, "A" + line), (12, line[::-1]),
    ]
    lines = [(d, n, s.strip(blanks)) for d, t in rows for n, s in enumerate((t or "").split("\n")) if len(s.strip(blanks)) >= 24]
    first = {}
    for d, n, s in lines:
        first.setdefault(s, (d, n))
    want = {}
    for d, n, s in lines:
        if first[s] != (d, n):
            want[d, n] = False
        elif any(first[o] < (d, n) and distance(o, s) <= threshold for o in first):
            want[d, n] = True
    got = {(r["doc_id"], r["line_no"]): r["near"] for r in linedup.repeated_lines(frame(spark, rows), threshold=threshold).collect()}
    assert got == want


def test_line_dedup_by_length(spark):
    """The registered thresholds: edits by the shorter line's length, and shorter lines exactly."""
    import random

    rng, rows = random.Random(5), []
    for n in [3, 23, 24, 47, 48, 95, 96, 99, 130, 191, 192, 196, 400]:
        base = "".join(rng.choice("abcdefgh  ") for _ in range(n - 2))
        rows += [f"x{base}y"] * 2
        for edits in (1, 2, 3, 4, 5, 7, 8, 9):
            for _ in range(2):
                line = list(f"x{base}y")
                for _ in range(edits):
                    at, kind = rng.randrange(1, len(line)), rng.randrange(3)
                    line[at : at + (kind != 1)] = [] if kind == 2 and len(line) > 2 else [rng.choice("ijk")]
                rows.append("".join(line))
    sentence = "a sentence of many common words in which somebody writes of a matter that is of no weight at all and goes on and on about it until " * 3
    rows += [sentence, sentence.replace("somebody", "anyone", 1), "short", "short", " ", " "]
    rng.shuffle(rows)
    first, want = {}, {}
    for d, s in enumerate(rows):
        first.setdefault(s.strip(" "), d)
    edits = lambda n: max([t for k, t in linedup.BY_LENGTH if k <= n], default=0)
    for d, s in enumerate(rows):
        s = s.strip(" ")
        if s and first[s] != d:
            want[d] = False
        elif any(first[o] < d and abs(len(o) - len(s)) <= edits(min(len(o), len(s))) and distance(o, s) <= edits(min(len(o), len(s))) for o in first if s and o):
            want[d] = True
    got = {r["doc_id"]: r["near"] for r in linedup.repeated_lines(frame(spark, list(enumerate(rows))), threshold=linedup.BY_LENGTH, exact_chars=1).collect()}
    assert got == want and sum(want.values()) > 50 and rows.index("short") not in got


def test_line_dedup_rounds(spark, monkeypatch):
    """Lines that share a segment and are not near end the rounds after the first, as no line is closed; variants of one line
    go on. Either way the lines found are those of brute force."""
    import random

    kept, made = linedup.written, []
    monkeypatch.setattr(linedup, "written", lambda df, name: made.append(name) or kept(df, name))
    rng = random.Random(3)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    opening, base = words(60), f"x{words(118)}y"
    apart = [f"x{opening}{words(60)}y" for _ in range(12)]
    variants = [base] + [base[:at] + "é" + base[at + 1 :] for at in range(5, 115, 9)]
    for rows, rounds in ((apart, 1), (variants + apart[:2], 2)):
        made.clear()
        want = {d for d, s in enumerate(rows) if any(distance(o, s) <= 4 for o in rows[:d])}
        got = {r["doc_id"] for r in linedup.repeated_lines(frame(spark, list(enumerate(rows))), threshold=linedup.BY_LENGTH).filter("near").collect()}
        assert got == want and len(want) == (0 if rows is apart else len(variants) - 1)
        assert made.count("pairs") == rounds + 1  # with the last search, of all pairs that are left


def test_line_distance(spark):
    """The masks against brute force: equal ends of all lengths, nothing between them, letters of several bytes."""
    import random

    rng, rows = random.Random(11), [("", ""), ("a", ""), ("", "aaaaa"), ("aaaa", "aaaaaaaa"), ("abab" * 9, "ab" * 19), ("é" * 40, "é" * 36), ("日本語" * 9, "日本" + "語日本" * 8)]
    for n in (1, 2, 7, 63, 64, 65, 200):
        for edits in (0, 1, 2, 3, 4, 5, 6):
            line = [rng.choice("abé") for _ in range(n)]
            other = line[:]
            for _ in range(edits):
                at, kind = rng.randrange(len(other) + 1), rng.randrange(3)
                other[at : at + (kind > 0)] = [] if kind == 2 else [rng.choice("ab日😀")]
            rows.append(("".join(line), "".join(other)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", *(linedup.within_distance(F.col("a"), F.col("b"), t).alias(f"t{t}") for t in (1, 2, 4))).collect()
    assert [(r["t1"], r["t2"], r["t4"]) for r in got] == [tuple(distance(r["a"], r["b"]) <= t for t in (1, 2, 4)) for r in got]


def test_line_dedup_keys(spark):
    """A line of 4, 2 or 1 edits has 13, 5 or 2 keys in its class, and lines that near share one that is the shorter one's own."""
    import random

    rng, rows, pairs = random.Random(8), [], []
    for low, high, edits in ((24, 48, 1), (48, 96, 2), (96, None, 4)):
        for n in (low, low + 1, low + edits, 2 * low - 1, *((239, 240, 241, 244, 500) if high is None else ())):
            for _ in range(25):
                base = [rng.choice("abc") for _ in range(n)]
                line, where = base[:], rng.randrange(3)
                for _ in range(edits):
                    at = rng.randrange(len(line)) if where == 0 else rng.randrange(12) if where == 1 else len(line) - 1 - rng.randrange(12)
                    kind = rng.randrange(3)
                    line[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("xyz")]
                if min(len(line), n) >= low and (high is None or min(len(line), n) < high):
                    pairs.append((edits, len(rows), len(rows) + 1))
                    rows += [(len(rows), n, "".join(base)), (len(rows) + 1, len(line), "".join(line))]
    lines = spark.createDataFrame(rows, "h long, n int, line string").select("h", "n", F.struct("line").alias("r"))
    for low, high, edits, most in ((24, 48, 1, 2), (48, 96, 2, 5), (96, None, 4, 13)):
        own, every = defaultdict(set), defaultdict(list)
        for r in linedup._keyed(lines, low, high, edits).collect():
            every[r["h"]].append(r["key"])
            own[r["h"]] |= {r["key"]} if r["own"] else set()
        assert min(map(len, every.values())) == most and max(map(len, every.values())) <= 2 * most
        for x, y in [(x, y) for e, x, y in pairs if e == edits]:
            short, long = sorted((x, y), key=lambda i: rows[i][1])
            assert own[short] & set(every[long]), (rows[short], rows[long])


def test_line_dedup_awkward(spark, odd, none):
    kept = linedup.without_repeats(odd)
    assert kept.columns == odd.columns and linedup.without_repeats(none).count() == 0 and linedup.report(none).count() == 0
    assert kept.filter("doc_id in (1, 2, 3)").count() == 3
    clean = "a line that is long enough to count\nand another line that is long enough"
    docs = frame(spark, [(1, clean, 1), (2, f"kept\n{clean}", 1), (3, clean, 1)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in linedup.without_repeats(docs).collect()} == {1: (clean, 1), 2: ("kept", 4)}
    line = "a line that is long enough to count"
    rows = [(1, line, 5), (7, f"intro\n{line}", 5), (7, "another\nUNIQUE words of this one", 5), (None, f"null id\n{line}", 5), (None, "also a null id\nand other words", 5)]
    clash = frame(spark, rows, "doc_id long, text string, line_numbers int").withColumns({c: F.lit(3) for c in ("_found_id", "found_id", "hash", "row", "id")})
    kept = linedup.without_repeats(clash)
    assert kept.columns == clash.columns and kept.filter("line_numbers <> 5 or hash <> 3").count() == 0
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "also a null id\nand other words"), (0, f"null id\n{line}"), (7, "another\nUNIQUE words of this one"), (7, "intro")]


def test_quality(spark, texts, odd, none):
    got = result(quality.quality(frame(spark, texts)))
    for d, t in texts:
        words, lines = re.findall(SPACE, t or ""), [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and not (r["base_failed"] and r["kept"])
    assert quality.quality(odd).count() == len(ODD) and quality.quality(none).count() == 0


def test_decontamination_over_blocks(spark):
    """A benchmark beyond one block, with repeated rows and many items of one text, is dealt evenly and found as a whole."""
    text = "one two three four five six seven eight nine ten eleven"
    bench = frame(spark, [(k, text) for k in range(200)] + [(7, text)] * 50 + [(500, "short item"), (501, None)], "item_id long, text string")
    docs = frame(spark, [(1, f"x {text} y"), (1, f"x {text} y"), (2, "a short item here"), (3, None), (4, "nothing")])
    want = Counter(tuple(r) for r in decontaminate.report(decontaminate.contamination(docs, bench)).collect())
    got = Counter(tuple(r) for r in decontaminate.report(decontaminate.contamination(docs, bench, block_bytes=1_000)).collect())
    assert got == want and {(r[0], r[3]) for r in got} == {(1, 200), (2, 1), (3, 0), (4, 0)}
    items, blocks = decontaminate._blocks(bench, "item_id", "text", 1_000)
    sizes = [r["count"] for r in items.groupBy("block").count().collect()]
    assert blocks > 10 and sum(sizes) == 201 and max(sizes) < 40
    assert {r["doc_id"] for r in decontaminate.uncontaminated(docs, bench, block_bytes=1_000).collect()} == {3, 4}


def test_toxicity_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert right >= 0.94 * len(rows) and sum(caught) >= 0.6 * len(caught)  # 38 toxic rows to learn from
    model = toxicity.learn(docs, labels)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.learn(none, frame(spark, [], "doc_id long, toxic int")) == toxicity.Model()


def test_toxicity_rate_of_a_bounded_sample(spark):
    """A sample of as many toxic rows as clean ones gives the rate of all labels."""
    rows = [(k, "the moon is far away." if k % 10 else "you are an idiot.", int(k % 10 == 0)) for k in range(6000)]
    rows = [(d, t, 1 - y if d % 7 == 0 else y) for d, t, y in rows]  # labels with errors, so that scores lie between 0 and 1
    all_ = frame(spark, rows, "doc_id long, text string, toxic int")
    docs, labels = all_.select("doc_id", "text"), all_.select("doc_id", "toxic")
    probes = frame(spark, [(1, "the moon is far away."), (2, "you are an idiot.")])
    whole, part = ({d: r["score"] for d, r in result(toxicity.score(probes, toxicity.learn(docs, labels, max_labelled=n))).items()} for n in (20_000, 1_500))
    assert all(abs(whole[d] - part[d]) < 0.06 for d in whole) and 0.05 < part[1] < 0.25


def test_toxicity_grammar():
    m = toxicity.Model()
    import pyarrow as pa

    plain, negated, reported, mild = toxicity._scan(m, pa.array(["you are an idiot.", "you are not an idiot.", "he said you are an idiot.", "you are kind."]), {})
    assert plain[0] > negated[0] == reported[0] == mild[0] == 0 and negated[4] > 0 and reported[5] > 0 and plain[3] > 0
