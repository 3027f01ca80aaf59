import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from liftpanel.llm.fast_sketches import shard_links
from liftpanel.llm.minhash_groups import links, set_print, set_prints, shingles, simhash, similar, similar_groups
from liftpanel.llm.simhash_bktree import RADIUS
from tests.conftest import SMALL
from tests.llm.cases import SCHEMA, bears_odd_tables, prose


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """Smallest place of each text's group, by all pairs."""
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def copies(rng):
    """Texts of 40 to 400 words, each with near copies that lie on either side of 0.8."""
    out = []
    for _ in range(12):
        words = prose(rng, rng.randint(40, 400)).split()
        out.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.04, 0.08):
            new = list(words)
            for at in rng.sample(range(len(new)), max(1, round(share * len(new)))):
                new[at] = f"other{rng.randrange(10**6)}"
            out.append(" ".join(new))
    return out


def test_groups_against_all_pairs(spark):
    texts = copies(random.Random(3))
    got = similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = plain_groups(texts)
    assert len(set(want)) > 12
    assert dict(got.select("doc_id", "component_id").collect()) == dict(enumerate(want))


def test_small_corpus_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = docs.collect()
    want = plain_groups([r["text"] for r in rows])
    got = dict(similar_groups(docs).select("doc_id", "component_id").collect())
    assert got == {r["doc_id"]: rows[w]["doc_id"] for r, w in zip(rows, want, strict=True)}


def test_stage_drops_near_copies_that_differ_in_a_few_words(spark):
    words = prose(random.Random(5), 150).split()
    near = [*words[:70], "another", *words[71:]]
    far = [w if i % 9 else "another" for i, w in enumerate(words)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate([words, near, far])]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, SCHEMA), SMALL)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


def test_similarity_and_shards():
    a, b = np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)
    assert similar(a, b) and not similar(a, b + np.uint64(2)) and similar(a[:80], a) and not similar(a[:79], a)
    assert len(shingles(b"")) == 0 and len(shingles(b"one two")) == 1


def test_odd_tables(spark):
    bears_odd_tables(spark, lambda d: similar_groups(d).drop("group_fingerprint"))


def signed(number):
    return int(np.uint64(number).view(np.int64))


def by_trees_alone(spark, texts, **columns):
    """Links as pairs of prints, where no two sets have a MinHash key in common."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = set_prints(docs, "doc_id", "text").withColumns({"keys": F.array().cast("array<bigint>"), **columns}).dropDuplicates(["fp"])
    return {frozenset(r) for r in links(docs, distinct, "text").collect()}


def test_trees_link_what_is_within_the_radius(spark):
    rng, texts = random.Random(11), []
    for _ in range(30):
        words = prose(rng, rng.randint(200, 800)).split()
        texts += [" ".join(words), " ".join([*words[:-1], f"other{rng.randrange(10**6)}"])]
    sets = [shingles(t.encode()) for t in texts]
    want = set()
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if (simhash(a) ^ simhash(b)).bit_count() <= RADIUS and similar(a, b):
                want.add(frozenset({signed(set_print(a)), signed(set_print(b))}))
    assert len(want) > 20
    assert by_trees_alone(spark, texts) == want


def test_trees_only_propose(spark):
    texts = copies(random.Random(9))[:12]
    sets = [shingles(t.encode()) for t in texts]
    head = min(sets, key=lambda s: signed(set_print(s)))
    want = {frozenset({signed(set_print(head)), signed(set_print(s))}) for s in sets if s is not head and similar(head, s)}
    assert want and by_trees_alone(spark, texts, bits=F.lit(0).cast("long")) == want


def test_what_is_tied_is_not_compared_again():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:95], a[:90]]
    assert len(shard_links([1, 2, 3], sets, None, 80)) == 2
    assert len(shard_links([1, 2, 3], sets, None, 80, [7, 7, 3])) == 1
    assert shard_links([1, 2, 3], sets, None, 80, [7, 7, 7]) == []
