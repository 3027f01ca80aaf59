"""Tables that every operator has to bear."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = (
    "fp fingerprint component_id root length start piece offset rank part score predicted held_out lang_pred words word "
    "marked m r t n owner spans base order label toxic quality stratum place terms path license item_id leak _1 count"
).split()


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    stems = {"en": "the ing ation er of and th st", "de": "der ung lich ein sch keit ber ß", "fr": "le eau ment ç é que oi é", "es": "el ción ado ñ os la mente ó"}[lang].split()
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and blank texts, one long text, ties, repeated rows, texts repeated under other ids."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 150), rng.choice(["en", "de", "fr", "es"])) for _ in range(24)]
    rows = [(i, t, rng.choice(["en", "de", None]), f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "src0", 1), (101, texts[3] + " more", "en", None, 1), rows[5], rows[5]]
    rows += [(102, None, "en", "src0", None), (103, "", None, "src1", 0), (104, " \n\t ", "de", "src1", 4), (105, "%%% 123", "en", "s", 7)]
    rows += [(None, texts[7], "fr", "src0", 1), (None, None, None, None, None), (106, " ".join(texts) + " " + "word " * 30_000, "en", "src0", 9)]
    return rows


def odd(spark, seed: int = 1):
    return spark.createDataFrame(odd_rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(docs):
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in docs.columns])


def rows_of(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.collect())


def bears_odd_tables(spark, operator, docs=None):
    """The operator's rows do not depend on further columns, on partitions or on order; an empty table gives none."""
    docs = odd(spark) if docs is None else docs
    want = rows_of(operator(docs))
    assert rows_of(operator(with_clashes(docs).repartition(5))) == want
    assert operator(empty(spark)).count() == 0
    return want
