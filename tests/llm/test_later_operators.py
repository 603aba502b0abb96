"""Hard negatives, the Merkle manifest and context mixing against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import context_mixing, merkle, negatives
from tests.llm.test_operators import AWKWARD, SCHEMA, SF
from tests.test_queries import TABLES, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {a: a + 32 for a in range(65, 91)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and embeddings with nulls, repeated rows, ties and further columns, each in a folder of tables."""
    top = tmp_path_factory.mktemp("tables")
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("ab cd Ef gh".split()) for _ in range(r.randrange(9))), r.choice(["en", "de", None, "en"]), r.choice(["s", None]), 3) for i in range(40, 180)]
    spark.createDataFrame(AWKWARD + docs, SCHEMA).selectExpr("*", "1 AS leaf", "2 AS pos", "'x' AS key", "0 AS n", "0 AS score", "1 AS bits").repartition(5).write.parquet(f"{top}/documents.parquet")
    return str(top)


@pytest.mark.parametrize("module", [negatives, merkle])
def test_query_equals_sql(spark, module):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in module.SQL.items():
        df = module.QUERIES[name](spark, SF)
        found = con.execute(sql)
        columns = [x[0] for x in found.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), columns)


# 12
def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(i, text, lang, source, n):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def plain_tree(nodes):
    """(root, the siblings of each node from the bottom up, as what stands before and after it)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            proofs[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level = [digest(*level[a : a + 8]) for a in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], proofs


def plain_manifest(rows):
    groups = {}
    for i, text, lang, source, n in rows:
        hit = i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaf = plain_leaf(i, text, lang, source, n)
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, plain_leaf(i, text.translate(UPPER), lang, source, n) if hit else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([leaf for _, _, leaf, _ in sorted(groups[x])]) for x in langs]
    root, over = plain_tree([t[0] for t in trees])
    out = []
    for lang, (subroot, proofs), above in zip(langs, trees, over, strict=True):
        for (has, i, leaf, other), below in zip(sorted(groups[lang]), proofs, strict=True):
            now = other
            for before, after in below + above:
                now = digest(before, now, after)
            out.append((i if has else None, leaf, subroot, root, digest(*[x for s in below + above for x in s]), now, now == root))
    return out


def test_manifest_equals_a_plain_one(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = [tuple(r) for r in merkle.op12_merkle(spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_none(spark, tmp_path):
    one = spark.createDataFrame(AWKWARD[:1], SCHEMA)
    tree = merkle.build(one, merkle.document_leaf())
    row = tree.paths().first()
    assert row["up"] == [] and row["subroot"] == tree.root == row["hash"]
    none = merkle.build(spark.createDataFrame([], SCHEMA), merkle.document_leaf())
    assert none.root is None and none.paths().count() == 0


def test_a_saved_manifest_gives_the_same_paths(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("key", "pos", "n", "leaf")
    tree = merkle.build(docs, merkle.document_leaf())
    tree.save(str(tmp_path / "m"))
    again = merkle.Manifest.load(spark, str(tmp_path / "m"))
    look = lambda t: sorted((r["key"], r["pos"], r["hash"], r["subroot"], [tuple(x) for x in r["up"]]) for r in t.paths().collect())
    assert again.root == tree.root and look(again) == look(tree)


# 11
def plain_negatives(rows):
    """rows: (id, label, integers), distinct, without nulls."""
    out = []
    for a, la, va in rows:
        if a % 50:
            continue
        score = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in rows if len(v) == len(va) and len(v)]
        score.sort()
        for s, p, _ in [x for x in score if x[2] == la and x[1] != a][:5]:
            fine = [(-n, i) for n, i, label in score if label != la and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(fine[:3])]
    return out


@pytest.mark.parametrize("block", [1 << 23, 64 * 8 * 3])
def test_negatives_equal_all_products(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(negatives, "SENT", block)
    r = np.random.default_rng(2)
    near = r.normal(size=(6, 24)) * 2
    rows = [(i, int(r.integers(0, 4)), [float(np.float32(x)) for x in near[i % 6] + r.normal(size=24) * (0.1 if i % 3 else 0)]) for i in range(400)]
    rows += [rows[3], (500, 1, [0.0] * 24), (501, 1, [1.5, -2.0]), (550, 2, [2.5, 1.0]), (502, 3, [1.0, 1.0]), (503, 2, [1.0, 2.0])]
    rows += [(600, None, [1.0] * 24), (650, 1, None), (700, 1, [None, *[1.0] * 23]), (750, 1, [float("nan")] * 24), (800, 1, [float("inf")] * 24), (850, 1, [1e300] * 24), (900, 1, []), (None, 1, [1.0] * 24)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "7 AS id", "'x' AS rank").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(x) for x in negatives.op11_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    fine = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < 1e6 for x in v)}
    assert sorted(got) == sorted(plain_negatives(sorted(fine))) and len(got) > 40


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert negatives.op11_negatives(spark, str(tmp_path)).count() == 0


def test_bounds_discard_most_and_lose_none():
    r = np.random.default_rng(5)
    base = r.normal(size=(3000, 8)) @ r.normal(size=(8, 64)) * 100
    rows = np.floor(base + r.normal(size=base.shape)).astype(np.int64)
    rotation = negatives.Rotation.fit(rows[:500])
    ids, labels = np.arange(3000), np.array(["a"] * 3000, object)
    search = negatives.Search(rotation, ids[:20], labels[:20], rows[:20], True, np.full((20, 1), -(1 << 60)), np.full((20, 1), 1 << 60), 5)
    search.prepare()
    search.add(ids, labels, rows)
    verified = []
    plain = np.einsum
    try:
        negatives.np.einsum = lambda s, a, b: verified.append(len(a)) or plain(s, a, b)
        search.add(ids, labels, rows)  # with what is known now as limits
    finally:
        negatives.np.einsum = plain
    want = rows[:20] @ rows.T
    for a in range(20):
        order = sorted((-want[a, i], i) for i in range(3000) if i != a)[:5]
        assert [(-s, i) for s, i in zip(search.best.score[a].tolist(), search.best.id[a].tolist(), strict=True)][:1] == order[:1]
    assert verified[-1] < 0.1 * 20 * 1024


# 13
def test_base_scores_equal_plain_ones(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in [*words(r["text"]), None])
    n, kinds = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in [*words(t), None])
    want = sorted((repr(r["doc_id"]), held(r["doc_id"]), len(words(r["text"])) + 1, sum(counts[w] > 0 for w in [*words(r["text"]), None]), n, round(base(r["text"]), 4)) for r in rows)
    got = context_mixing.op13_context_mixing(spark, folder).collect()
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and len({r["score"] for r in got if r["doc_id"] == 9}) == 1


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert context_mixing.op13_context_mixing(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(4)
    pairs = {w: r.sample("red blue green old new fast slow warm cold".split(), 2) for w in "house car tree river road bird".split()}
    say = lambda: " ".join(f"the {r.choice(pairs[w])} {w}" for w in r.choices(list(pairs), k=r.randrange(5, 30)))
    texts = spark.createDataFrame([(say().encode(),) for _ in range(400)] + [(f"name{i} {chr(97 + i % 26)}ord{i % 7}".encode(),) for i in range(60)], "text binary")
    words = context_mixing.C.staged(context_mixing.count_words(texts), "lm-test")
    return context_mixing.train(texts, words), words, say


def test_model_beats_counts_where_context_tells(spark, model):
    m, words, say = model
    new = spark.createDataFrame([(i, say()) for i in range(50)], "doc_id long, text string")
    got = context_mixing.score(new, m, words).collect()
    assert all(r["score"] > r["base_score"] for r in got)
    assert sum(r["bits"] for r in got) < 0.5 * sum(-r["base_score"] / math.log10(2) for r in got)


def test_probabilities_sum_to_one_at_most(model):
    """Of all symbols after any context, and of all bytes of a new word."""
    m = model[0]
    n = m.coded + 2
    for before in ([], [0], [1, 0]):
        # code_texts() adds up a text's bits; what the last symbol adds is its cost, for nothing is learnt inside a first block
        texts = [np.array([*before, s]) for s in range(n)]
        whole = m.code_texts(np.concatenate(texts), np.array([len(t) for t in texts]))
        start = m.code_texts(np.array(before, np.int64), np.array([len(before)]))[0] if before else 0.0
        assert sum(2 ** (start - b) for b in whole) == pytest.approx(1, abs=1e-3)
    single = [bytes([b]) for b in range(256) if chr(b) not in " \t\n\x0b\x0c\r"]
    assert sum(2 ** -(m.spell([w])[0]) for w in single) <= m.new + 1e-6


def test_scores_do_not_depend_on_neighbours(model):
    """A long text's later blocks learn from its own earlier ones alone."""
    m, _, say = model
    long = m.ranks([" ".join(say() for _ in range(40)).encode().split()])
    one, _ = m.symbols(long, np.array([len(long)]))
    alone = m.code_texts(one, np.array([len(one)]))[0]
    both = m.code_texts(np.concatenate([one[:50], one, one[:9]]), np.array([50, len(one), 9]))
    assert both[1] == pytest.approx(alone, rel=1e-5)
    assert m.code_texts(one[:300], np.array([300]))[0] < alone


def test_rare_words_are_joined(spark, model, monkeypatch):
    """The same scores' base whether words are sent to the tasks or joined."""
    _, words, say = model
    texts = spark.createDataFrame([(w, f"{w.decode()} the house {w.decode()} unseen{i}") for i, w in enumerate(r["word"] for r in words.where("word is not null").limit(40).collect())], "w binary, text string")
    train = texts.select(context_mixing.F.col("text").cast("binary").alias("text"))
    counted = context_mixing.C.staged(context_mixing.count_words(train), "lm-test")
    whole = {r["w"]: (r["base_score"], r["n_known"]) for r in context_mixing.score(texts, context_mixing.train(train, counted), counted).collect()}
    monkeypatch.setattr(context_mixing, "SENT", 5)
    few = context_mixing.train(train, counted)
    assert len(few.index) <= 5
    assert {r["w"]: (r["base_score"], r["n_known"]) for r in context_mixing.score(texts, few, counted).collect()} == whole


def test_long_words_are_spelt_in_parts(model, monkeypatch):
    m = model[0]
    words = [b"short", b"abc" * 700, b"x", b"ordinary" * 90, b"y" * 1000]
    whole = m.spell(words)
    monkeypatch.setattr(context_mixing, "RUN", 50)
    assert m.spell(words) == pytest.approx(whole, rel=1e-6)
    assert [m.spell([w])[0] for w in words] == pytest.approx(list(whole), rel=1e-6)


def test_every_training_text_teaches_the_first_weights(spark):
    """Few texts, none of which a hash would have picked as one in 32."""
    F = context_mixing.F
    texts = spark.createDataFrame([(f"the cat {i} sat on the mat and the cat {i} ran",) for i in range(40)], "text string").select(F.col("text").cast("binary").alias("text"))
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(32)) != 0)
    words = context_mixing.C.staged(context_mixing.count_words(texts), "lm-every").where(F.pmod(F.xxhash64("word"), F.lit(32)) != 0)
    m = context_mixing.train(texts, words)
    assert (m.weights != 0.35).any() and (m.byte_weights != 0.3).any()


def test_learning_runs_over_all_tasks_at_once(spark):
    """No job for each part of the texts: these would run one after another."""
    F, context = context_mixing.F, spark.sparkContext
    texts = spark.range(60).select(F.concat(F.lit("the cat sat on mat "), F.col("id").cast("string")).cast("binary").alias("text")).repartition(40)
    words = context_mixing.C.staged(context_mixing.count_words(texts), "lm-tasks")
    context.setJobGroup("lm-tasks", "learning")
    try:
        context_mixing.train(texts, words)
        assert len(context.statusTracker().getJobIdsForGroup("lm-tasks")) < 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_texts_are_predicted_before_they_are_counted(spark):
    """The first text of a task teaches from nothing that it says itself; counts are of all."""
    rows = spark.createDataFrame([(bytearray(b"x"),)] * 3, "text binary").coalesce(1)

    def events(batches):
        stage = np.zeros(2, np.int64)
        for batch in batches:
            for _ in range(batch.num_rows):
                yield iter([([np.array([5, 5])], np.array([True, True]), [], lambda s: s[0], stage)])

    counters, weights, _ = context_mixing.gather(rows, 1, 16, np.full((4, 1), 0.5), np.zeros((1, context_mixing.BINS)), events)
    assert counters.counts[0, 1, 5] == 6 and counters.counts.sum() == 6
    # before them the slot had 0, 2 and 4 ones: gate 1 (1 or 2) and gate 2 (3 to 15) learn, gate 0 has a logit of zero
    assert weights[0, 0] == 0.5 and weights[1, 0] > 0.5 and weights[2, 0] > 0.5 and weights[3, 0] == 0.5
