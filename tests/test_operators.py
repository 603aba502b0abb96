import math
import re
import zipfile

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import change, chunking, concepts, entities, graph, impact, relations, retrieval, views
from lodestone.plans import impact_analysis
from lodestone.sources import files, tables


def sequential_chunks(text, most=180, overlap=30):
    sents = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", text)]
    sents = [(s, len(re.findall(r"\w+|[^\w\s]", s))) for s in sents if s]
    out, own, total = [], [], 0
    for s, n in sents:
        if total and total + n > most:
            out.append(own)
            kept, size = [], 0
            for t, m in reversed(own):
                if size + m > overlap:
                    break
                kept.insert(0, (t, m))
                size += m
            own, total = kept, size
        own = [*own, (s, n)]
        total += n
    return [" ".join(s for s, _ in c) for c in [*out, own] if c]


def test_chunks_equal_a_sequential_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in chunking.chunks(docs).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append(r["content"])
    for r in docs.collect():
        assert got.get(r["doc_id"], []) == sequential_chunks(r["text"])


def test_no_chunks_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, " "), (3, "...")], "doc_id int, text string")
    assert chunking.chunks(docs).count() == 0
    assert {(r[0], r[1]) for r in chunking.rejected(docs).collect()} == {(1, "no text"), (2, "no text"), (3, "no chunks")}


def test_change_subjects(spark):
    rows = spark.createDataFrame(
        [
            (0, "Change the cache-lifetime limit in CAT-7 from 15 minutes to 5 minutes."),
            (1, "Update the answer window from 4 hours to 1 hour for urgent tickets."),
            (2, "Change the timeout from 4 business hours to 1 business hour."),
        ],
        "id int, query string",
    )
    got = {r["id"]: r for r in change.specified(rows).collect()}
    assert got[0]["subject"] == "cache-lifetime limit in CAT-7" and got[0]["direction"] == "DECREASE"
    assert got[1]["subject"] == "answer window" and got[1]["magnitude"] == 0.75
    assert got[2]["magnitude"] is None and got[2]["direction"] == "CHANGE"
    assert got[0]["concepts"][0] == got[0]["subject"] and "the" not in got[0]["concepts"]


def test_impact_chain(spark):
    names = ["Payment", "Payment API", "Payment Gateway", "Checkout Workflow"]
    nodes = spark.createDataFrame(list(zip("abcd", names, ["SYSTEM", "API", "SYSTEM", "WORKFLOW"], [0.90, 0.85, 0.80, 0.75])), "id string, name string, entity_type string, importance double")
    edges = spark.createDataFrame([("a", "b", "USES", 0.9), ("b", "c", "USES", 0.9), ("c", "d", "SUPPORTS", 0.9)], "source string, target string, relationship_type string, confidence double")
    seeds = spark.createDataFrame([("a", 0.95)], "id string, semantic double")
    got = {r["id"]: r for r in impact.propagate(nodes, edges, seeds).collect()}
    assert {k: r["score"] for k, r in got.items()} == {"a": 0.9425, "b": 0.8655, "c": 0.4290}
    assert [got[k]["level"] for k in "abc"] == ["HIGH", "HIGH", "LOW"] and got["c"]["path"] == ["a", "b", "c"]
    assert impact.explained(impact.propagate(nodes, edges, seeds), nodes).count() == 3
    assert graph.shortest_path(edges, "a", "d").first()["path"] == ["a", "b", "c", "d"]
    assert graph.shortest_path(edges, "a", "x").count() == 0


def test_seeds_stop_before_a_tier_that_they_cannot_pass(spark):
    edges = spark.createDataFrame([(a, b, "USES", 1.0) for a, b in ("ab", "bc", "cd", "xb")], "source string, target string, relationship_type string, confidence double")
    nodes = spark.createDataFrame([(n, n, "API", 1.0) for n in "abcdx"], "id string, name string, entity_type string, importance double")
    found = graph.reach(edges, spark.createDataFrame([("a", 3), ("x", 1)], "id string, most int"), 3)
    assert {(r["seed"], r["node"]) for r in found.collect()} == {("a", "b"), ("a", "c"), ("a", "x"), ("a", "d"), ("x", "b")}
    for semantic, far in ((0.73, "d"), (0.71, "c"), (0.39, "b"), (0.11, "a")):
        got = impact.propagate(nodes, edges, spark.createDataFrame([("a", semantic)], "id string, semantic double")).collect()
        assert max(r["id"] for r in got if r["id"] != "x") == far


def test_relations_of_sentences(spark):
    chunks = spark.createDataFrame([(0, "Cart Service depends on Parcel Engine. Parcel Engine and Cart Service are old."), (1, "Related APIs: A1, B2, C3")], "chunk_id int, content string")
    names = spark.createDataFrame([(0, "q", "Cart Service"), (0, "r", "Parcel Engine"), (1, "a", "A1"), (1, "b", "B2"), (1, "c", "C3")], "chunk_id int, id string, name string")
    got = {tuple(r) for r in relations.extract(chunks, names).drop("evidence", "confidence").collect()}
    assert got == {(0, "q", "r", "DEPENDS_ON"), (1, "a", "b", "RELATED_API"), (1, "b", "c", "RELATED_API")}


def test_name_relations(spark):
    cases = [
        ("payment processing", "successful payment processing", "DESCRIPTIVE_EXTENSION"), ("payment failures", "checkout payment failures", "CONTEXT_EXTENSION"),
        ("payment processing", "customer database", "STRUCTURAL_MISMATCH"), ("checkout workflow", "checkout workflow the checkout workflow", "REPEATED_NAME_ARTIFACT"), ("a b", "b a", "EXACT_DUPLICATE"),
    ]
    rows = spark.createDataFrame(cases, "a string, b string, expected string")
    assert rows.where(entities.relation(F.split("a", " "), F.split("b", " ")) != F.col("expected")).count() == 0
    judged = spark.createDataFrame([("CONTEXT_EXTENSION", 0.92, 0.90), ("CONTEXT_EXTENSION", 0.95, 0.88), ("DESCRIPTIVE_EXTENSION", 0.95, 0.91)], "relation string, dense double, combined double")
    assert [r["confidence"] for r in entities.judged(judged).orderBy("combined").collect()] == ["REVIEW", "HIGH"]


def test_merge_rounds_and_resolution(spark):
    rows = [(i, n, "SYSTEM", [1.0, 0.0]) for i, n in enumerate(["payment processing", "successful payment processing", "old successful payment processing", "customer ledger"])]
    found = spark.createDataFrame(rows, "id int, normalized_name string, entity_type string, vector array<double>")
    merges = {tuple(r) for r in entities.merge_rounds(found, "MEDIUM").collect()}
    assert (1, 0) in merges and all(k != 3 and d != 3 for d, k in merges)
    ordered = found.select(F.lit("o").alias("organization_id"), "entity_type", "id", "normalized_name", "vector", F.col("id").alias("position"))
    assert {r["id"]: r["canonical_id"] for r in entities.resolve_in_order(ordered).collect()}[1] == 0


def test_names_and_files(spark, tmp_path):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(X.safe_filename(F.lit("a/b/../c?.txt"))) == "c_.txt" and get(X.safe_filename(F.lit("..."))) == "document"
    assert get(X.normalize_name(F.lit(" The  Rate/Engine (v2)! "))) == "the rate/engine v2"
    assert get(X.clean_name(F.lit("the Parcel  Engine's of"), entities.EDGES)) == "Parcel Engine"
    assert get(entities.entity_type(F.lit("Stock Service API"))) == "API"
    assert get(views.size_text(F.lit(1536))) == "1.5 KB" and get(views.extension(F.lit("a.docx"))) == "DOCX" and get(views.initials(F.lit("ann b cole"))) == "AB"
    assert get(views.size_bytes(F.lit('{"size_bytes": "x"}'))) == 0
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text(" hello ")
    (tmp_path / "b.exe").write_text("no")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    got = {r["name"]: (r["extracted_text"], r["reason"]) for r in files.with_text(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("hello", None) and got["b.exe"][1] == "unsupported type" and got["c.docx"][1].startswith("unreadable")


def test_set_metrics(spark):
    side = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    r = views.set_metrics(side(["a", " B ", "c"]), side(["A", "b", "d", ""])).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and abs(r["f1"] - 2 / 3) < 1e-9


def test_merging_and_paths_go_on_to_the_end(spark):
    rows = [(0, "payment processing")] + [(i, f"w{i} payment processing") for i in range(1, 26)]
    found = spark.createDataFrame([(i, n, "SYSTEM", [1.0, 0.0]) for i, n in rows], "id int, normalized_name string, entity_type string, vector array<double>")
    assert {tuple(r) for r in entities.merge_rounds(found, "REVIEW").collect()} == {(i, 0) for i in range(1, 26)}
    chain = [(f"n{i}", f"n{i + 1}", "USES", 0.9) for i in range(9)]
    edges = spark.createDataFrame(chain, "source string, target string, relationship_type string, confidence double")
    assert graph.shortest_path(edges, "n9", "n0").first()["path"] == [f"n{i}" for i in reversed(range(10))]
    assert graph.shortest_path(edges, "n0", "x").count() == graph.shortest_path(edges, "n0", "n9", 8).count() == 0


SPAN = "id int, name string, normalized_name string, start int, end int, score double, source string"


def kept_spans(spark, *spans):
    rows = [(1, n, n.lower(), a, b, s, k) for n, a, b, s, k in spans]
    return sorted((r["name"], r["start"]) for r in entities.without_overlaps(spark.createDataFrame(rows, SPAN)).collect())


def test_overlapping_spans(spark):
    # a part of a longer name goes there, and stays where it stands alone
    assert kept_spans(spark, ("Stock API", 0, 11, 1.0, "NAMED"), ("Stock API Gateway", 0, 19, 1.0, "NAMED"), ("Stock API", 40, 51, 1.0, "NAMED")) == [("Stock API", 40), ("Stock API Gateway", 0)]
    # spans that overlap in part both stay; a structural one takes a noun phrase's place
    assert kept_spans(spark, ("Alpha Beta", 0, 10, 0.9, "NAMED"), ("Beta Gamma", 6, 16, 0.8, "NAMED")) == [("Alpha Beta", 0), ("Beta Gamma", 6)]
    assert kept_spans(spark, ("Alpha Team", 0, 10, 0.9, "STRUCTURAL"), ("Team Gamma", 6, 16, 0.95, "PHRASE")) == [("Alpha Team", 0)]
    # a containing span takes the place of one kept span only
    assert kept_spans(spark, ("One API", 0, 7, 1.0, "NAMED"), ("Two API", 8, 15, 1.0, "NAMED"), ("One Two Three", 0, 20, 0.1, "NAMED")) == [("One Two Three", 0), ("Two API", 8)]


def test_every_place_of_a_name(spark):
    chunks = spark.createDataFrame([(1, "Parcel Engine reads. And then Parcel Engine writes."), (2, None), (3, "")], "chunk_id int, content string")
    got = {(r["normalized_name"], r["start"]) for r in entities.candidates(chunks).collect()}
    assert ("parcel engine", 0) in got and any(n == "parcel engine" and s > 0 for n, s in got)


def test_annotated_spans(spark):
    word = lambda t, pos, stop=False, starts=False, root=False: (t, t.lower(), pos, stop, starts, root)
    rows = [
        (1, "Acme", 0, 4, "ORG", [word("Acme", "PROPN", starts=True)]),
        (2, "Monday", 0, 6, "DATE", [word("Monday", "PROPN", starts=True)]),
        (3, "the rate lock policy", 0, 20, None, [word("the", "DET", True), word("rate", "NOUN"), word("lock", "NOUN"), word("policy", "NOUN", root=True)]),
        (4, "quickly done", 0, 12, None, [word("quickly", "ADV"), word("done", "VERB", root=True)]),
        (5, "thing", 0, 5, None, [word("thing", "NOUN", root=True)]),
        (6, None, 0, 0, None, None),
    ]
    kind = "id int, text string, start int, end int, label string, tokens array<struct<text:string,lemma:string,pos:string,stop:boolean,starts:boolean,root:boolean>>"
    got = {(r["id"], r["name"], r["score"]) for r in entities.annotated(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, "Acme", 0.95), (3, "rate lock policy", 0.72)}


def test_concepts_of_few_documents(spark):
    docs = spark.createDataFrame([(1, "rate lock rate"), (2, "lock desk"), (3, None)], "doc_id int, text string")
    phrases = spark.createDataFrame([("Rate Lock.",), (" rate  lock",), ("thing",), ("ab",), ("1234",), ("a b c d e f",), ("nowhere",), (None,)], "phrase string")
    got = {r["name"]: r for r in concepts.discover(docs, phrases).collect()}
    assert set(got) == {"Rate Lock", "rate lock", "nowhere"} and got["nowhere"]["importance"] == 0
    # by hand: smooth idf, sublinear counts, unit rows
    idf = lambda df: math.log(4 / (1 + df)) + 1
    one = {"rate": (1 + math.log(2)) * idf(1), "lock": idf(2), "rate lock": idf(1), "lock rate": idf(1), "rate lock rate": idf(1)}
    two = {"lock": idf(2), "desk": idf(1), "lock desk": idf(1)}
    length = lambda d: math.sqrt(sum(x * x for x in d.values()))
    expected = ((one["rate"] + one["lock"]) / length(one) + two["lock"] / length(two)) / (3 * 2)
    assert abs(got["Rate Lock"]["importance"] - expected) < 1e-9
    assert concepts.discover(docs.limit(0), phrases).where("importance > 0").count() == 0


def test_resolution_of_a_batch(spark):
    chunks = spark.createDataFrame([(10, 2, 0), (11, 1, 0)], "id int, document_id int, chunk_index int")
    rows = [(1, 10, 0, "o", "API", "rate api", [1.0, 0.0]), (2, 11, 0, "o", "API", "rate lock api", [1.0, 0.05]), (3, 11, 1, "o", "API", "desk", [0.0, 1.0])]
    mentions = spark.createDataFrame(rows, "id int, chunk_id int, place int, organization_id string, entity_type string, normalized_name string, vector array<double>")
    got = {r["id"]: r["canonical_id"] for r in entities.resolve_batch(mentions, chunks).collect()}
    assert got == {1: 2, 2: 2, 3: 3}  # document 1 comes first, so its name founds the entity


def test_equal_names_are_paired_with_no_one(spark):
    rows = [(i, "rate lock", "API", [1.0]) for i in range(40)] + [(99, "new rate lock", "API", [1.0])]
    found = entities.duplicates(spark.createDataFrame(rows, "id int, normalized_name string, entity_type string, vector array<double>"))
    assert {(r["first_id"], r["second_id"]) for r in found.collect()} == {(i, 99) for i in range(40)}
    assert [r["first_id"] for r in entities.in_order(found).limit(1).collect()] != []


def test_cascade_falls_back_to_names(spark):
    rows = [("a", "Alpha", 0, ["a"], 0.9), ("b", "Beta", 1, [" ALPHA ", "b"], 0.8), ("c", "Gamma", 2, ["x", "c"], 0.7), ("d", "Delta", 4, ["y", "d"], 0.6)]
    got = {r["id"]: (r["parent"], r["x"], r["y"]) for r in views.cascade(spark.createDataFrame(rows, "id string, name string, distance int, path array<string>, score double")).collect()}
    assert got == {"a": (None, 420, 70), "b": ("a", 810, 70), "c": ("b", 1200, 70), "d": (None, 1980, 70)}


def test_similarity_by_hand(spark):
    rows = spark.createDataFrame([(1, "rate lock"), (2, "desk"), (3, None)], "id int, text string")
    got = {r["id"]: r["lexical"] for r in retrieval.similarity_to("rate desk desk", rows, "id", "text").collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    q = {"rate": idf(2), "desk": 2 * idf(2), "rate desk": idf(1), "desk desk": idf(1)}
    one = {"rate": idf(2), "lock": idf(1), "rate lock": idf(1)}
    length = lambda d: math.sqrt(sum(x * x for x in d.values()))
    assert abs(got[1] - q["rate"] * one["rate"] / length(q) / length(one)) < 1e-9
    assert abs(got[2] - q["desk"] / length(q)) < 1e-9 and got[3] == 0


def test_analysis_of_a_request(spark):
    chunks = spark.createDataFrame([(1, 7, "The rate lock service calls the stock api."), (2, 8, "Nothing of that."), (3, 8, "Lunch is at noon.")], "id int, document_id int, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "id int, vector array<double>")
    mentions = spark.createDataFrame([(1, "s", "Rate Lock Service", "locks a rate", 0), (1, "p", "Stock API", None, 1), (2, "s", "rate lock", "", 0)], "chunk_id int, canonical_id string, name string, description string, place int")
    nodes = spark.createDataFrame([("s", "Rate Lock Service", "SYSTEM", [1.0, 0.0]), ("p", "Stock API", "API", [0.0, 1.0]), ("t", "Desk Team", "TEAM", [0.0, 1.0])], "id string, name string, entity_type string, vector array<double>")
    edges = spark.createDataFrame([("s", "p", "CALLS", 1.0), ("p", "t", "OWNED_BY", 1.0), ("s", "gone", "CALLS", 1.0)], "source string, target string, relationship_type string, confidence double")
    documents = spark.createDataFrame([(7, "b.txt"), (8, "a.txt")], "id int, filename string")
    ask = lambda query: {r["id"]: r for r in impact_analysis.analyze(chunks, vectors, mentions, nodes, edges, documents, query, [1.0, 0.0]).collect()}
    got = ask("Change the rate lock service from 5 to 3 days.")
    assert got["s"]["distance"] == 0 and got["s"]["category"] == "DIRECT_CHANGE" and [d["filename"] for d in got["s"]["documents"]] == ["a.txt", "b.txt"]
    assert got["p"]["path"] == ["s", "p"] and got["p"]["label"] == "CALLS" and [d["filename"] for d in got["p"]["documents"]] == ["b.txt"]
    assert "t" not in got or (got["t"]["category"] == "STAKEHOLDER" and got["t"]["documents"] == [])
    assert ask("  ") == {}
    hits = impact_analysis.relevant_chunks(chunks, vectors, "rate lock", [1.0, 0.0], 10)
    rated = {r["id"]: r for r in impact_analysis.entity_scores(hits, mentions, nodes, "rate lock", [1.0, 0.0]).collect()}
    assert rated["s"]["similarity"] > 0.75 and rated["p"]["similarity"] == 0 and not rated["s"]["named"]


def test_tables_and_merges(spark, tmp_path):
    canonical = spark.createDataFrame([(1, "o", "api"), (2, "o", "API"), (3, "x", "API"), (4, "o", "TEAM")], "id int, organization_id string, entity_type string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 1), (1, 9)], "keep_id int, drop_id int")
    good = entities.validated(pairs, canonical)
    assert [tuple(r) for r in good.select("keep_id", "drop_id").collect()] == [(1, 2)]
    mentions = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id int, canonical_id int")
    moved, left = entities.merge(mentions, canonical, good)
    assert {tuple(r) for r in moved.select("id", "canonical_id").collect()} == {(10, 1), (11, 1), (12, 3)} and left.count() == 3 and entities.left_behind(moved, good).count() == 0
    path = str(tmp_path / "sink")
    tables.insert(mentions, path, {"canonical_id": (canonical, "id")})
    tables.insert(spark.createDataFrame([(13, 99)], mentions.schema), path, {"canonical_id": (canonical, "id")})
    assert spark.read.parquet(path).count() == 3
    files.write_by_tenant(canonical, str(tmp_path / "tenants"))
    files.write_by_tenant(canonical.where("organization_id = 'x'"), str(tmp_path / "tenants"))
    assert spark.read.parquet(str(tmp_path / "tenants")).count() == 4
    tables.store_files(spark.createDataFrame([("o", 1, ".txt", b"hi")], "organization_id string, document_id int, suffix string, content binary"), str(tmp_path / "store"))
    assert (tmp_path / "store" / "organization_id=o").is_dir()


def test_a_good_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    assert files.with_text(files.read_files(spark, str(tmp_path))).first()["extracted_text"] == "One two\n\nThree"
