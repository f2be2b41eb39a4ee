import random

import corpus_pipeline
from pyspark.sql import functions as F

from sigloom.llm import langid, tokens
from sigloom.llm.queries import tokenizer_path

UNLEARNED = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. ",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. ",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "for (int i = 0; i < n; i++) { x[i] = malloc(sizeof(*p) * 17); if (!x[i]) return -1; } ",
]


def test_unlearned_languages_and_letter_soup_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(5)
    soup = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (20, 100, 1000)]
    bad = [*UNLEARNED, *(5 * t for t in UNLEARNED), *soup]
    more = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(bad)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, both, "").select("doc_id").collect()}
    assert {x for x in kept if x >= 10**6} == set()
    assert kept == {x.doc_id for x in langid.identify(docs).filter(F.col("lang_pred") != "und").collect()}


def test_cut_without_right_predictions_or_with_one_language(spark):
    one = spark.createDataFrame([(k, "some words here", "en") for k in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(one)
    assert langid.keep_identified(one, model, 0.2, lift=langid.least_lift(one, model)).count() == 20
    assert langid.least_lift(one.withColumn("lang", F.lit("fr")), model) == 0
    assert langid.least_lift(one.limit(0), model) == 0


def test_texts_are_judged_before_the_rows_are_asked_for(spark):
    """What is judged later is judged in batches of the session's size, whatever this operator asks for."""
    docs = spark.createDataFrame([(k, f"some words {'here' if k % 2 else '1 2 3'}" if k % 3 else None, "en") for k in range(20)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs, langid.fit(docs), 0.2)
    assert "Python" not in (plan := kept._jdf.queryExecution().toString()) and "InArrow" not in plan
    assert {r.doc_id for r in kept.collect()} == {k for k in range(20) if k % 3}


def test_a_worker_that_judges_keeps_no_tokenizer():
    tokens.encoder(tokenizer_path(), 50)
    langid.judge(["some words"], langid.Model([], None, None, None, langid.Settings()))
    assert not tokens.encoder.cache_info().currsize
