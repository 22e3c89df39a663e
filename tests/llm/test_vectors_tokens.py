"""Operators 11 to 13 against brute force, the tokenizer's library, and SQL on the smallest tables."""

import random
import sys
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import fixtures

from rowtide.llm import clusters, codes, registry, tokens, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, code string, sums string, error int"
DATA = Path("/root/testdata/sf0.001")


def rows(seed=3, n=400, dims=64):
    """Vectors around a few centres, with repeated rows, ties, and what must be left out."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    made = []
    for k in range(n):
        centre = centres[0] if k % 3 == 0 else rng.choice(centres)
        vector = [float(np.float32(c + rng.gauss(0, 0.05))) for c in centre]
        if k % 11 == 0:
            vector = [float(round(c)) for c in centre]  # many equal ones
        made.append((k * 2, vector, None if k % 7 == 0 else k % 3, 1, "x", "y", 2))
    made += [made[3], made[3], (made[4][0], made[5][1], 1, 1, None, None, None), (None, made[6][1], None, 1, None, None, None)]
    bad = [None, [], [1.0] * (dims - 1), [1.0] * (dims + 1), [None] + [0.0] * (dims - 1), [float("nan")] + [0.0] * (dims - 1), [0.0] * (dims - 1) + [float("inf")]]
    return made, [(900 + k, v, 1, 1, None, None, None) for k, v in enumerate(bad)]


def whole(vector, scale):
    return [int(np.floor(scale * x)) for x in vector]


def last_if_none(x):
    return (x is None, x or 0)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute_clusters(made, k=16, rounds=3, scale=64):
    kept = [(r[0], whole(r[1], scale), r[1]) for r in made]
    digest = lambda r: (r[0] is None, "" if r[0] is None else sha256(f"1:{r[0]}".encode()).hexdigest(), r[2])
    centroids = [r[1] for r in sorted(kept, key=digest)[:k]]
    for at in range(rounds + 1):
        own = [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v, _ in kept]
        if at < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v, _), (_, o) in zip(kept, own, strict=True) if o == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = {j: sum(d for d, o in own if o == j) for j in range(len(centroids))}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digests[j]) for (i, _, _), (d, j) in zip(kept, own, strict=True)), key=repr)


def brute_codes(made, parts=16, entries=64, rounds=2, scale=256):
    kept = [(r[0], whole(r[1], scale), r[2], r[1]) for r in made]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (last_if_none(r[0]), r[3]))[:entries]
    books = [[cut(v)[p] for _, v, _, _ in first] for p in range(parts)]
    for at in range(rounds + 1):
        own = [[min((apart(x, e), j) for j, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _, _ in kept]
        if at < rounds:
            for p in range(parts):
                for j in range(len(first)):
                    mine = [cut(r[1])[p] for r, o in zip(kept, own, strict=True) if o[p][1] == j]
                    if mine:
                        books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in o) for o in own]
    labels = {}
    for r, e in zip(kept, error, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in o), e, labels[r[2]], digest) for r, o, e in zip(kept, own, error, strict=True)), key=repr), books


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clusters(spark):
    made, bad = rows()
    found = clusters.clustered(spark.createDataFrame(made + bad, SCHEMA).repartition(5))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collected(found) == brute_clusters(made)


def test_fewer_vectors_than_centroids(spark):
    made, bad = rows()
    made = made[:3]
    assert collected(clusters.clustered(spark.createDataFrame(made + bad, SCHEMA))) == brute_clusters(made)
    found, _ = brute_codes(made)
    assert collected(codes.compressed(spark.createDataFrame(made + bad, SCHEMA))) == found


def test_codes(spark):
    made, bad = rows()
    found = codes.compressed(spark.createDataFrame(made + bad, SCHEMA).repartition(5))
    want, books = brute_codes(made)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collected(found) == want
    # what a code stands for is as far from its vector as it says
    stands = codes.decoded(found, np.array(books)).select("code", "vector", "error").collect()
    by_code = {r.code: [x for p in range(16) for x in books[p][int(r.code[2 * p : 2 * p + 2], 16)]] for r in stands}
    assert all(r.vector == by_code[r.code] for r in stands)


def test_no_vectors(spark):
    _, bad = rows()
    for made in ([], bad):
        df = spark.createDataFrame(made, SCHEMA)
        for found in (clusters.clustered(df), codes.compressed(df)):
            assert found.collect() == []


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="or more in size"):
        clusters.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


@pytest.mark.parametrize("size", [4, 1 << 26])
def test_searches_are_exact(size):
    rng = np.random.default_rng(5)
    centres, x = rng.integers(-size, size, (13, 64)), rng.integers(-size, size, (300, 64))
    x[:20], centres[7] = centres[3], centres[3]  # ties
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    own, distance = clusters.nearest(x, centres, rng.permutation(64))
    assert (own == d.argmin(1)).all() and (distance == d.min(1)).all()
    entries, parts = rng.integers(-size, size, (64, 4)), rng.integers(-size, size, (300, 4))
    entries[9] = entries[2]
    parts[:20] = entries[2]
    cells, d = codes.Cells(entries), ((parts[:, None] - entries[None]) ** 2).sum(-1)
    lower, upper = cells.bounds(parts)
    assert (lower <= d).all() and (d <= upper).all()
    own, distance = cells.nearest(parts)
    assert (own == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_bounds_leave_few_candidates():
    rng = np.random.default_rng(6)
    entries, parts = rng.integers(-100, 100, (64, 4)), rng.integers(-100, 100, (500, 4))
    lower, upper = codes.Cells(entries).bounds(parts)
    assert (lower <= upper.min(1)[:, None]).mean() < 0.25


def test_integers_floor_downwards(spark):
    import pyarrow as pa

    kept, x = vectors.integers(pa.array([[-0.01, 0.01], None, [1.0, None], [-1.0, 0.999]], pa.list_(pa.float32())), 2, 64)
    assert kept.tolist() == [0, 3] and x.tolist() == [[-1, 0], [-64, 63]]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())


@pytest.fixture(scope="module")
def counter():
    return tokens.Prefixes(tokens.model_path())


def texts(library):
    rng = random.Random(8)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    odd = lambda: chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x300), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F6FF)]))
    made = ["", " ", "   ", "\n", "▁", "▁ ▁x", "<s> </s> <unk> <0x0A>", "\x00a\x00", "a" * 70, "é" * 40, " " * 40 + "\n" + " " * 17, "日本語の文章 とても長い", "hello hello  hello"]
    for k in range(60):
        made.append("".join(rng.choice(pieces) for _ in range(10)).replace("▁", rng.choice([" ", "▁"])))
        made.append("".join(rng.choice("ab  etn\n ,.▁") for _ in range(50)))
        made.append("".join(odd() for _ in range(25)))
    return made


def test_every_prefix_counts_as_the_tokenizer_has_it(library, counter):
    for text, steps in zip(made := texts(library), counter.steps(made), strict=True):
        assert [0, *np.cumsum(steps, dtype=int).tolist()] == [len(library.encode(text[:n])) for n in range(len(text) + 1)], text


def test_a_full_memory_changes_nothing(library, counter, monkeypatch):
    made = texts(library)
    want = [x.tolist() for x in counter.steps(made)]
    monkeypatch.setattr(tokens, "KEPT", 20)
    monkeypatch.setattr(tokens, "PAIRS", 10)
    small = tokens.Prefixes(tokens.model_path())
    assert [small.steps([text])[0].tolist() for text in made] == want
    assert [x.tolist() for x in small.steps(made)] == want


def test_token_counts(spark, library):
    docs = fixtures.frame(spark, fixtures.documents())
    found = tokens.prefixes(docs, tokens.model_path())
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_bytes", "n_tokens").collect()), key=repr) == want
    assert tokens.prefixes(docs.limit(0), tokens.model_path()).count() == 0


def test_budgets_and_truncation(spark, library):
    docs = fixtures.frame(spark, fixtures.documents()).filter("length(text) < 600 or text is null")
    stored = tokens.prefixes(docs, tokens.model_path(), with_text=True).withColumn("asked", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") - 5))
    for r in tokens.tokens_at(stored, "asked").collect():
        assert r.tokens_at == (None if r.asked is None else len(library.encode((r.text or "")[: max(r.asked, 0)])))
    for budget in (-1, 0, 1, 30):
        for r in tokens.fitting(stored, budget).collect():
            fits = [n for n in range(len(r.text or "") + 1) if len(library.encode((r.text or "")[:n])) <= budget]
            assert r.fit_chars == (fits[-1] if fits else 0)
    cut = {(r.doc_id, r.text, r.n_tokens) for r in tokens.truncated(docs, tokens.model_path(), 30).collect()}
    assert all(len(library.encode(text or "")) <= 30 and (n > 30) == any(d.doc_id == i and len(d.text or "") > len(text or "") and len(library.encode(d.text or "")) == n for d in docs.collect()) for i, text, n in cut)


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_clusters", "op13_codes"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    found, want = registry.queries()[name](spark, str(DATA)), con.sql(registry.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(found.select(*names).collect()) == as_text(want.select(*names).fetchall())


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_token_query(spark, library):
    found = tokens.op12_tokens(spark, str(DATA))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in docs)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
