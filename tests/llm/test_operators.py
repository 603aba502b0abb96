"""The training-data operators against plain versions, and on awkward rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from lodestone.llm import common, html_text, lines, mixing, pieces, quality, sharding, simhash, token_files, toxicity, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (5, None, None, None, None), (6, "", "en", "s1", 0), (7, "   \n\t ", "en", "s1", 6), (8, "one", "en", None, 3), (9, "one", "en", "s2", 3), (9, "one", "en", "s2", 3), (10, "x " * 20000, "en", "s2", 40000),
    (11, "a b c d e f g\na b c d e f g\na b c d X f g\nshort\nshort", "de", "s1", 50), (None, "no id here at all, and so on", "fr", "s3", 28), (12, "▁ odd  spaces \r\n end ", "es", "s3", 20),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "1 AS size", "'x' AS score", "2 AS n_words", "3 AS component", "4 AS kept", "5 AS slot")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = components(nodes, [x for x in links if x[0] != x[1]])
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, None)], "id long, k string")
    table = rows.where("k is not null").groupBy("k").agg({"id": "min", "*": "count"}).withColumnsRenamed({"min(id)": "first", "count(1)": "n"})
    got = {r["id"]: r["first"] for r in common.lookup(rows, table, "k", ["first"], "n", rows["id"]).collect()}
    assert len(got) == 3001 and got[1] == got[2] == 1 and got[300] == 300 and got[9999] is None


# 1
def whole_ids(text):
    return token_files._tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def test_ids_of_odd_texts(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 40)
    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = ["a", "the", "The", ".", " ", ", ", "\n", "  ", "\n\n", "<|endoftext|>", "é", "日", "'s", "'", "12", ",", "!?", "\t", "\xa0", " ", "don't", " \n", "\n ", "...", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1200)]
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], e.encode(texts[at : at + 100]), strict=True):
            assert ids.tolist() == whole_ids(text), repr(text)


def test_huffman_codes():
    r = np.random.default_rng(2)
    for n, limit in ((1, 20), (2, 20), (300, 9), (5000, 20)):
        counts = (r.pareto(0.4, n) * 10 + 1).astype(np.int64)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
    counts = np.array([1, 1, 2, 4, 8, 16])
    assert (token_files.code_lengths(counts) * counts).sum() == 62  # the unlimited optimum
    lengths = token_files.code_lengths(np.bincount(r.zipf(1.3, 5000) % 700, minlength=700))
    ids = r.choice(np.flatnonzero(lengths), 5 * token_files.BLOCK + 17)
    payload, marks = token_files.pack_bits(ids, lengths, token_files.canonical_codes(lengths))
    assert token_files.Decoder(lengths)(payload, marks, len(ids)).tolist() == ids.tolist()


def test_token_files(spark, awkward, empty, docs):
    for df in (awkward, docs):
        path = common.new_path(spark, "test-ids")
        token_files.write_ids(df, path)
        got = token_files.read_ids(spark, path).collect()
        want = sorted(((r["doc_id"], whole_ids(r["text"]) + [2]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((i or -1, len(x)) for i, x in want)
        if df is docs:
            start = 0
            digests = {r["doc_id"]: r for r in token_files.read_digests(spark, path).collect()}
            for r, (i, ids) in zip(sorted(got, key=lambda r: r["start"]), want, strict=True):
                raw = np.array(ids, "<u4").tobytes()
                assert (r["doc_id"], r["start"], bytes(r["ids"])) == (i, start, raw) and digests[i]["ids_crc32"] == zlib.crc32(raw)
                start += len(ids)
    path = common.new_path(spark, "test-ids")
    token_files.write_ids(empty, path)
    assert token_files.read_ids(spark, path).count() == 0


# 2
def test_tightest_bin_equals_a_scan():
    r = random.Random(5)
    sizes, capacity = [r.randint(1, 60) for _ in range(400)], 100
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(left, b) for b, left in enumerate(room) if left >= sizes[i]]
        b = min(fits)[1] if fits else len(room)
        room = room if fits else [*room, capacity]
        room[b] -= sizes[i]
        want[i] = b
    assert sharding.best_fit_decreasing(sizes, capacity) == want


def test_shards(spark, awkward, empty, docs):
    rows = sharding.pack(docs).collect()
    load, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert len(rows) == docs.count() and len(load) == 16 and max(load.values()) < 1.01 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    odd = sharding.pack(awkward).collect()
    assert len(odd) == len(AWKWARD) and {r["size"] for r in odd if r["doc_id"] in (5, 6)} == {1}
    assert sharding.pack(empty).count() == 0
    copies = spark.createDataFrame([(i, "same text") for i in range(640)], "doc_id long, text string")
    assert sorted(Counter(r["shard"] for r in sharding.pack(copies).collect()).values())[0] >= 25  # a group over a fair share is cut


# 3
def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(400, 64))
    near = np.repeat(base[:60], 6, axis=0) + r.normal(size=(360, 64)) * 0.15
    rows = np.concatenate([base, near, base[:5], base[:3] * 2])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    bad = [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [None, *[1.0] * 63]), (9004, [1.0, 2.0]), (9005, [float("inf")] * 64)]
    got = {x["vec_id"]: x for x in vectors.near_duplicates(spark.createDataFrame(data + bad, "vec_id long, embedding array<double>"), leaf=64).collect()}
    norm = np.linalg.norm(rows, axis=1)
    hit = rows @ rows.T / (norm[:, None] * norm) >= 0.95
    np.fill_diagonal(hit, False)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert all(got[i]["n_links"] <= hit[i].sum() for i in range(len(rows))) and found >= 0.9 * hit.sum()
    want = components(range(len(rows)), zip(*np.nonzero(hit), strict=True))
    assert sum(got[i]["component_id"] == want[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in bad)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_of_a_large_leaf(spark, monkeypatch):
    r = np.random.default_rng(6)
    one = r.normal(size=64)
    data = [(i, [float(x) for x in one + r.normal(size=64) * 0.05]) for i in range(150)]
    monkeypatch.setattr(vectors, "BLOCK", 40)
    got = vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), leaf=32).collect()
    assert {x["n_links"] for x in got} == {149} and {x["component_id"] for x in got} == {0}


# 4
def plain_dedup(rows):
    seen, subs, longer, out = set(), set(), set(), {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            w = tuple(WORD.findall(line))
            if len(w) >= lines.LEAST_WORDS:
                sub = {(k, w[:k], w[k + 1 :]) for k in range(len(w))}
                less = {w[:k] + w[k + 1 :] for k in range(len(w))}
                gone = w in seen or not sub.isdisjoint(subs) or not less.isdisjoint(seen) or w in longer
                seen.add(w)
                subs |= sub
                longer |= less
                if gone:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines_equal_a_plain_version(spark, awkward, empty):
    r = random.Random(8)
    vocabulary = "aa bb cc dd".split()
    texts = [(i, "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 5)))) for i in range(150)]
    got = {x["doc_id"]: x["text"] for x in lines.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == plain_dedup(texts)
    odd = {x["doc_id"]: x for x in lines.dedup(awkward).collect()}
    assert odd[11]["text"] == "a b c d e f g\nshort\nshort" and odd[11]["n_dropped"] == 2 and odd[5]["text"] is None and odd[6]["text"] == ""
    assert lines.dedup(empty).count() == 0


def test_running_hashes_do_not_depend_on_what_follows(spark):
    words = [f"w{i % 97}" for i in range(1300)]
    df = spark.createDataFrame([(1, words), (2, words[:700]), (3, [])], "id int, w array<string>")
    got = {x["id"]: x["h"] for x in df.select("id", lines.running_hashes(df["w"]).alias("h")).collect()}
    assert len(got[1]) == 1301 and got[2] == got[1][:701] and len(got[3]) == 1


# 5
def test_machine_learns_pairs():
    r = random.Random(9)
    terms = toxicity.Terms(1 << 12)
    texts, labels = [], []
    for _ in range(600):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join([r.choice(["they", "people"]) if not a else "outsiders", *["thing"] * 2, "awful" if b else "fine"]))
        labels.append(int(a and b))
    examples = [terms.windows(t) for t in texts]
    m = toxicity.Machine(1 << 12, 4)
    m.fit(examples, np.array(labels), epochs=20, rate=0.3)
    scores = np.array([m.raw(i, w, 1).max() for i, w in examples])
    assert ((scores > 0) == np.array(labels)).mean() > 0.97


def test_toxicity(spark, awkward, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.op5_toxicity(spark, d).join(labels, "doc_id").where("held_out").collect()
    hit, wrong = sum(r["predicted"] and r["toxic"] for r in rows), sum(r["predicted"] and not r["toxic"] for r in rows)
    assert hit >= 0.75 * sum(r["toxic"] for r in rows) and wrong <= 0.02 * len(rows)
    machine = toxicity.train(docs.limit(0), labels.limit(0))
    got = toxicity.score(awkward, machine).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got) and toxicity.score(empty, machine).count() == 0


# 6
PAGE = """<html><head><title>T</title><script>if (a</p>b) {}</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies on this site and you agree to all of them.</div>
<article><h1>A title &amp; more</h1><p>First   paragraph<br>goes <b>on</b> for a while, as paragraphs of articles do in general.<p>Second &eacute; one, also with enough words to count as text.</p>
<p>Of.</p><aside>Related things</aside><form><p>Your name</p></form><div class="comments"><p>I like this a lot, thank you very much for writing it.</p></div></article>
<footer>&copy; us</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A title & more\n\nFirst paragraph goes on for a while, as paragraphs of articles do in general.\n\nSecond é one, also with enough words to count as text.\n\nOf."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav><a>x</a></nav>") == ""
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<div>" * 3000 + "deep text here") == "deep text here"


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "old", 5), (2, None, None, None, None), (2, None, "", None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(rows).collect()
    assert len(got) == 3 and max(r["n_chars"] for r in got) == len(html_text.main_text(PAGE)) and html_text.extract(rows.limit(0)).count() == 0


# 7
def fingerprint(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, awkward, empty, docs):
    for df in (docs, awkward):
        rows = [(r["doc_id"], r["text"]) for r in df.where("doc_id is not null").collect()]
        prints = [(i, fingerprint(t)) for i, t in rows]
        links = [(a, b) for (a, x), (b, y) in itertools.combinations(prints, 2) if (x ^ y).bit_count() <= 4]
        want = components({i for i, _ in prints}, links)
        got = simhash.near_duplicates(df.where("doc_id is not null")).collect()
        assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got)
        assert sorted((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == sorted(prints)
    assert simhash.near_duplicates(awkward).count() == len(AWKWARD) and simhash.near_duplicates(empty).count() == 0


def test_meeting_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS", 1 << 12)
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = sorted({x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for x in base for _ in range(4)})
    fp = np.array(prints, np.uint64)
    out = []
    simhash._meet(fp, fp, np.full(len(fp), 2), 64, 4, out)
    got = simhash._roots(len(fp), np.concatenate(out))
    want = components(range(len(fp)), [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert got.tolist() == [want[i] for i in range(len(fp))]


# 8


def test_hot_buckets_are_dealt_without_losing_a_link(spark, monkeypatch):
    r = np.random.default_rng(8)
    middle = int(r.integers(0, 1 << 63))
    flip = lambda x, n: int(x) ^ sum(1 << int(b) for b in r.choice(64, n, replace=False))
    fps = {flip(middle, int(n)) for n in r.integers(0, 9, 400)} | {int(x) for x in r.integers(0, 1 << 63, 300)}
    fps |= {flip(x, 4) for x in sorted(fps)[:100]}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    monkeypatch.setattr(simhash, "LEAST", 20)
    monkeypatch.setattr(simhash, "HOT", 0.01)
    pairs = simhash.near_pairs(spark.createDataFrame([(x, x) for x in signed], "node long, _fp long")).collect()
    want = components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4])
    assert components(signed, [(p["a"], p["b"]) for p in pairs]) == want and len(set(want.values())) < len(signed) - 100


def all_segmentations(lattice, unit):
    out = []

    def go(at, score, ids):
        if at == len(unit):
            out.append((score, ids))
            return
        single = False
        for end in range(at + 1, min(len(unit), at + 16) + 1):
            if found := lattice.pieces.get(unit[at:end]):
                single = single or end == at + 1
                go(end, score + found[1], [*ids, found[0]])
        if not single:
            go(at + 1, score + lattice.unknown, ids + [lattice.bytes[b] for b in unit[at : at + 1].encode()])

    go(0, 0.0, [])
    return sorted(out, reverse=True)


def test_segmentations_equal_enumeration():
    e = pieces.Encoder(pieces.model_path(), 4)
    for text in ["The cat", "a b c", "héllo wörld", "foo  bar ", " x", "日本▁語", "a\nb c", "the the the"]:
        want, got = all_segmentations(e.lattice, " " + text), e(text)
        assert [s for s, _ in got] == [s for s, _ in want[:4]]
        assert len({i for _, i in got}) == len(got) and all((s, np.frombuffer(i, "<u4").tolist()) in want for s, i in got)
        assert all(e.lattice.decode(i) == text for _, i in got)
    assert e("") == [(0.0, b"")]


def test_pieces_round_trip(spark, awkward, empty, docs):
    for df in (docs, awkward):
        texts = Counter((r["doc_id"], r["text"] or "") for r in df.collect())
        assert Counter((r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(df)).collect()) == texts
        assert pieces.digests(df).where("round_trip").count() == df.count()
    assert pieces.encode(empty).count() == 0


# 9
def test_fit_comes_as_near_as_a_search():
    r = random.Random(12)
    for _ in range(40):
        lengths = sorted(r.sample(range(1, 60), 5))
        counts = [r.randint(1, 3) for _ in lengths]
        budget = r.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        take = mixing.fit(lengths, counts, budget)
        got = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and got <= budget
        assert budget - got <= max(lengths)
    assert mixing.targets([10, 100, 100], [3, 1, 2]) == pytest.approx([20, 295 / 3, 590 / 3])
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [3, 1]) == [0, 7.5]


def test_mix(spark, awkward, empty, docs):
    rows = mixing.mix(docs).collect()
    taken, goal = Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(goal[s] - 0.03 * goal[s] <= taken[s] <= goal[s] + 1 for s in goal)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(awkward).count() == len(AWKWARD) and mixing.mix(empty).count() == 0


def test_equal_rows_are_told_apart_where_the_budget_ends(spark):
    rows = [(1, "two words", "a")] * 1000 + [(i, "one", "b") for i in range(10, 700)] + [(2, "three small words", "c")] * 40
    docs = spark.createDataFrame(rows, SCHEMA.replace(", lang string", "").replace(", n_chars long", "")).repartition(7)
    got = mixing.mix(docs).collect()
    taken, goal = Counter(), {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert len(got) == len(rows) and all(-1 < goal[s] - taken[s] < 3 for s in goal)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


# 10
def plain_stats(text):
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(5)}
    own = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)


def test_quality(spark, awkward, empty, docs):
    for df in (docs, awkward):
        for r in quality.judge(df).collect():
            got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]
            assert got == plain_stats(r["text"]) and r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])
            assert not (r["base_failed"] and r["kept"])
    assert quality.judge(empty).count() == 0


def test_word_distance_equals_a_plain_one(spark):
    refs = {"xx": {"the": 0.3, "of": 0.1}, "yy": {"le": 0.2}}
    text = "The of the. of THE cat le " * 20
    got = spark.createDataFrame([(text,)], "t string").select(quality.word_distance(quality.F.split(quality.F.lower("t"), quality.PARTED), refs)).first()[0]
    words = [w for w in re.split(quality.PARTED, text.lower())]
    want = []
    for ref in refs.values():
        p = {w: words.count(w) / len(words) for w in ref}
        p["*"], q = 1 - sum(p.values()), ref | {"*": 1 - sum(ref.values())}
        part = lambda a, m: a * np.log2(a / m) if a > 0 else 0.0
        want.append(np.sqrt(sum((part(p[k], (p[k] + q[k]) / 2) + part(q[k], (p[k] + q[k]) / 2)) / 2 for k in q)))
    assert abs(got - min(want)) < 1e-9


def divergence(p, q):
    part = lambda a, m: a * np.log2(a / m) if a > 0 else 0.0
    return np.sqrt(max(0.0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q, strict=True))))


def plain_classes(t):
    by = [len(re.findall(c, t)) for c in quality.CLASSES]
    by[quality.SPACES_AT] += t.count(" ")
    by.append(len(t.encode()) - len(t))
    return [*by, len(t) - sum(by[:-1])]


def test_verdict_equals_a_plain_one(spark, docs):
    rows = [r for r in docs.select("doc_id", "text", "lang").collect()]
    rows += [(90_001, "".join(chr(0x400 + i % 32) + " " * (i % 7 == 0) for i in range(900)), "zz"), (90_002, "#$% @@ {} 12345 " * 60, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by_lang = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            by_lang.setdefault(lang, []).append(t)
    total = sum(map(len, by_lang.values()))
    by_lang = {k: v for k, v in by_lang.items() if len(v) >= max(quality.LEAST_DOCS, quality.LEAST_SHARE * total)}
    assert "zz" not in by_lang  # a lone document isn't its own reference
    classes, common_words = [], []
    for texts in by_lang.values():
        c = np.sum([plain_classes(t) for t in texts], axis=0)
        classes.append(c / c.sum())
        n = Counter(w for t in texts for w in re.split(quality.PARTED, t.lower()) if w)
        common_words.append({w: k / sum(n.values()) for w, k in sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]})
    judged = {r["doc_id"]: r for r in quality.judge(table).collect()}
    for i, t, lang in rows:
        t, r = t or "", judged[i]
        c, ws = np.array(plain_classes(t), float), re.split(quality.PARTED, t.lower())
        far_class = min(divergence(c / c.sum(), q) for q in classes) if c.sum() >= quality.LEAST_CHARS else None
        far_word = None
        if len(ws) >= quality.LEAST_WORDS:
            n = Counter(ws)
            far_word = min(divergence([*[n[w] / len(ws) for w in q], 1 - sum(n[w] for w in q) / len(ws)], [*q.values(), 1 - sum(q.values())]) for q in common_words)
        for got, want in ((r["class_distance"], far_class), (r["word_distance"], far_word)):
            assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-6), (i, got, want)
        limit = quality.WORD_LIMIT + quality.NOISE / math.sqrt(max(1, r["n_words"]))
        assert r["kept"] == (not r["base_failed"] and not (far_class or 0) > quality.CLASS_LIMIT and not (far_word or 0) > limit)
    assert not judged[90_001]["kept"] and not judged[90_002]["kept"]


def test_a_rare_language_is_no_free_pass(spark, docs):
    junk = "".join(chr(0x400 + i % 32) + " " * (i % 7 == 0) for i in range(900))
    rows = [(90_000 + i, junk, lang) for i, lang in enumerate(["zz", "zz", "en", None])]
    judged = quality.judge(docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).where("doc_id >= 90000")
    assert {r["kept"] for r in judged.collect()} == {False}


# pipeline
def test_stages_on_awkward_rows(spark, awkward, empty, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (awkward, empty):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            before = now.columns
            now = common.staged(stage(spark, now, str(tmp_path)), f"test-{name}")
            assert stage is corpus_pipeline.pieces_stage or now.columns == before
        assert (now.count() > 0) == (df is awkward)


# 4, lines with more than one edit
def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_longer_lines_go_within_more_edits(spark):
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for size in (38, 39, 40, 41, 59, 60, 61, 80, 130):
        head = [r.choice(vocabulary) for _ in range(15)]
        for _ in range(3):
            words = head + [r.choice(vocabulary) for _ in range(size - 15)]
            texts.append(words)
            for edits in range(1, size // 20 + 3):
                own = list(r.choice(texts[-3:]))
                for _ in range(edits):
                    at, what = r.randrange(len(own)), r.randrange(3)
                    own[at : at + (what != 0)] = [] if what == 1 else [r.choice(vocabulary)]
                texts.append(own)
    # the earliest line that shares words with the last isn't close to it, the next is
    start = [f"s{i}" for i in range(20)]
    other = start + [f"t{i}" for i in range(40)]
    texts += [start + [f"u{i}" for i in range(40)], other, [*other[:30], "x", *other[31:50], "y", *other[51:]]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {x["doc_id"] for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped = 1").collect()}
    want = {j for j in range(len(texts)) if any(word_distance(texts[i], texts[j]) <= max(1, max(len(texts[i]), len(texts[j])) // 20) for i in range(j))}
    assert got == want and len(texts) - 1 in want and 20 < len(want) < len(texts) - 20


def test_exact_repeats_of_short_lines_go(spark, tmp_path):
    rows = [(1, "All rights reserved.\nHi\n\n  \nbye now", "en", "s1", 1), (2, "Hi\nAll  rights reserved.\n\n  \nbye then", "en", "s1", 1), (3, "Hi", "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    done = {x["doc_id"]: (x["n_lines"], x["n_dropped"]) for x in lines.op4_lines(spark, str(tmp_path)).collect()}
    assert done == {1: (5, 0), 2: (5, 2), 3: (1, 1)}


# 6, one huge block among short ones
@pytest.mark.parametrize("holder, name", [("article", "section"), ("div", "div")])
def test_a_huge_block_does_not_hide_short_sections(holder, name):
    texts = [f"{i} " + "word " * 79 + "end" for i in range(11)]
    texts.insert(5, "long " * 12000 + "end")
    page = f"<body><nav><a href=x>Menu</a></nav><{holder}>" + "".join(f"<{name}><p>{t}</p></{name}>" for t in texts) + f"</{holder}></body>"
    assert html_text.main_text(page) == "\n\n".join(texts)


# 9, against all choices
def test_fit_equals_all_choices():
    r = random.Random(5)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 40), 4))
        counts = [r.randint(0, 4) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = r.randint(0, total)
        least = [c * budget // total if total > budget else c for c in counts]  # every length gives its share at least
        sums = {sum(n * t for n, t in zip(lengths, take, strict=True)) for take in itertools.product(*[range(a, c + 1) for a, c in zip(least, counts, strict=True)])}
        take = mixing.fit(lengths, counts, budget)
        assert sum(n * t for n, t in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)


# 5, against the double sum
def test_scores_equal_the_double_sum():
    machine = toxicity.Machine(64, 4, seed=3)
    machine.w[:] = np.random.default_rng(1).normal(size=64)
    machine.v[:] = np.random.default_rng(2).normal(size=(64, 4))
    machine.bias = 0.3
    rows = {0: [1, 5, 9], 1: [2], 3: [7, 8, 60, 61]}
    ids = np.array([i for own in rows.values() for i in own])
    got = machine.raw(ids, np.array([k for k, own in rows.items() for _ in own]), 4)
    for k in range(4):
        own = rows.get(k, [])
        x = 1 / math.sqrt(len(own)) if own else 0.0
        want = 0.3 + sum(float(machine.w[i]) * x for i in own) + sum(float(machine.v[i] @ machine.v[j]) * x * x for i, j in itertools.combinations(own, 2))
        assert abs(got[k] - want) < 1e-4


# 6, what must stay and what must not crash
LONG = "A long paragraph of the article, with many words in it, that goes on and on for the reader. " * 5


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        (f"<article><p>{LONG}</p><table><tr><td>12</td><td>ab</td></tr></table><blockquote>Quote it.</blockquote></article>", ["12", "ab", "Quote it."], []),
        (f"<article><p>{LONG * 9}</p><section><h2>Sub</h2><p>tiny.</p></section></article><footer>Imprint</footer>", ["Sub", "tiny."], ["Imprint"]),
        (f"<![foo[ bar ]]><![%x;[ a ]]><main><p>{LONG}</p></main>", [LONG.strip()], []),
        (f"<!DOCTYPE html [<!ENTITY a 'b'>]><nav><a href=x>Menu</a></nav><main><p>{LONG}</p></main>", [LONG.strip()], ["Menu"]),
        (f"<body><div id=nav><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></div><div><p>{LONG}</p><p>{LONG}</p></div><div class=footer>Imprint</div></body>", [LONG.strip()], ["Home", "Imprint"]),
        (f"<article><p>{LONG}</p><section><a href=x>The whole sentence is one link to read.</a></section><div class=more><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div></article>", ["one link to read."], ["One", "Two"]),
        (f'<article><p>{LONG}</p><div class="notice-board-history"><p>The board of 1820.</p></div><section id="menu"><h2>Menu of the feast</h2><p>Soup, then fish.</p></section></article>', ["The board of 1820.", "Menu of the feast", "Soup, then fish."], []),
        (f'<article><p>{LONG}</p><div class="cookie-notice">We use them.</div><div id="comments"><p>First reader.</p></div><ul class="share-buttons"><li>Tell all</li></ul></article>', [LONG.strip()], ["We use", "First reader", "Tell all"]),
        (f"<article><p>{LONG}</p></article><!-- never closed <p>lost</p>", [LONG.strip()], ["never closed", "<p>", "lost"]),
        (f"<main><!--><p>{LONG}</p><!-- a > b --><p>Last.</p></main>", [LONG.strip(), "Last."], ["a > b"]),
    ],
)
def test_regions_of_planted_pages(html, kept, gone):
    text = html_text.main_text(html)
    assert all(x in text for x in kept) and not any(x in text for x in gone)


def test_many_open_elements():
    n = 10_000
    text = html_text.main_text("<article>" + "<div>word " * n + "</span>" * n + "</article>")
    assert text.count("word") == n


# 3, pairs near the limit
def test_pairs_near_the_limit_are_found(spark):
    r, rows = np.random.default_rng(8), []
    for k in range(400):
        a = r.normal(size=32)
        a /= np.linalg.norm(a)
        b = r.normal(size=32)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = r.uniform(0.951, 0.97)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = {x["vec_id"]: x["component_id"] for x in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(400)) >= 392


def test_vectors_of_every_length_and_size(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(10, [1.0, 0.0, 0.0]), (11, [2.0, 0.0, 0.0]), (12, [1e300, 0.0]), (13, [1e-300, 1e-302]), (14, [0.0, 5e-324]), (15, [0.0, 1e308]), (16, []), (17, None), (18, [0.0, 0.0]), (19, [1.0, None]), (20, [float("nan"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (6, 0, i == 0) for i in (0, 1, 2, 3, 4, 12, 13))
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False) and got[14] == (1, 14, True) and got[15] == (1, 14, False)
    assert all(got[i] == (0, i, True) for i in range(16, 21))
    r = np.random.default_rng(4)
    two = [(1000 * d + i, r.normal(size=d).tolist()) for d in (8, 16) for i in range(300)]
    two += [(i + 500, v) for i, v in two if i % 3 == 0]
    found = vectors.near_duplicates(spark.createDataFrame(two, "vec_id long, embedding array<double>"), leaf=64).collect()
    plain = {i: np.array(v) / np.linalg.norm(v) for i, v in two}
    for x in found:
        own = plain[x["vec_id"]]
        near = [i for i, v in plain.items() if len(v) == len(own) and own @ v >= 0.95]
        assert x["n_links"] == len(near) - 1


# pipeline, each stage on what the one before kept
def test_run_keeps_what_each_stage_decides(spark, tmp_path):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = now
        now = common.staged(stage(spark, now, SF), f"test-{name}")
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    machine = toxicity.train(seen["toxicity"], spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(seen["toxicity"], machine).collect()}
    assert ids(seen["line_dedup"]) == Counter(i for i in ids(seen["toxicity"]).elements() if scores[i] < corpus_pipeline.TOXIC_FROM)
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in seen["simhash"].collect()}
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(prints.items(), 2) if (x ^ y).bit_count() <= 4]
    assert set(ids(seen["mixing"])) == set(components(set(prints), links).values())
    times = {r["doc_id"]: r["times"] for r in mixing.mix(seen["mixing"]).collect()}
    assert ids(seen["pieces"]) == Counter({i: n for i, n in times.items() if n})
    assert ids(now) == ids(seen["pieces"]) and now.where("not round_trip").count() == 0
    one = {r["doc_id"]: r["text"] for r in seen["pieces"].collect()}
    encoder = pieces.Encoder(pieces.model_path(), pieces.N_BEST)
    for r in now.limit(50).collect():
        assert r["ids_crc32"] == zlib.crc32(encoder(one[r["doc_id"]] or "")[0][1])


def test_lines_are_shuffled_in_turns_and_without_their_texts(spark, monkeypatch):
    """The same lines go whatever the number of turns; where words are looked up, no text leaves the task that reads it."""
    r = random.Random(11)
    say = lambda n: " ".join(r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    base = [say(n) for n in (3, 6, 12, 45, 60)]
    texts = [(i if i % 9 else None, "\n".join(r.choice([x, x + " more", say(8), say(50), ""]) for x in base)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc long, text string").selectExpr("doc", "xxhash64(text) as rev", "text")
    every = []
    for turns in (1, 2, 3):
        monkeypatch.setattr(lines, "TURNS", turns)
        every.append({tuple(x) for x in lines.dropped_lines(docs, short_repeats=True).collect()})
    assert every[0] and every[0] == every[1] == every[2]
    wanted = docs.selectExpr("doc", "rev", "0 as line").where("text not like '\n%'").distinct()
    found = lines._with_words(docs, wanted)
    own = {(d, v): t.split("\n")[0].split(" ") for d, v, t in docs.collect()}
    assert {(x["doc"], x["rev"]): x["words"] for x in found.collect()} == {k: v for k, v in own.items() if v != [""]}
    shuffled = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1:]]
    assert shuffled and all("Generate posexplode" in x for x in shuffled[:1]) and "collect_list" not in shuffled[0]
