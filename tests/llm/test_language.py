from pyspark.sql import functions as F

from glintsieve.llm import language
from glintsieve.llm.queries import op3_language_id


def test_backoff_goes_to_shorter_grams():
    model = language.LanguageModel({"aa": {"gato": 5, "gata": 3}, "bb": {"hund": 5, "bund": 2}})
    assert model.predict("gato gata")[0] == "aa"
    assert model.predict("gatos")[0] == "aa"  # unseen, known by its 4-grams
    assert model.predict("und")[0] == "bb"
    assert model.predict("zzz")[0] in ("aa", "bb")
    long, short = model.score_word("gatos"), model.score_word("gzzzz")
    assert (long != short).any()


def test_undetermined_and_bounds():
    model = language.LanguageModel({"aa": {"gato": 5}})
    for text in (None, "", "12 34 ... ½ ²", "́"):
        assert model.predict(text) == (language.UNDETERMINED, 0.0)
    assert language.LanguageModel({}).predict("gato") == (language.UNDETERMINED, 0.0)
    for text in ("gato", "gato " * 5000, "Ünknown", "漢字"):
        lang, score = model.predict(text)
        assert lang == "aa" and 0 <= score <= 1


def test_the_cache_does_not_change_results():
    model = language.LanguageModel({"aa": {"gato": 5}, "bb": {"hund": 5}})
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(40)) for i in range(30)]
    first = [model.predict(t) for t in texts]
    kept, language.CACHED_WORDS = language.CACHED_WORDS, 10
    try:
        assert [model.predict(t) for t in texts] == first
    finally:
        language.CACHED_WORDS = kept


def test_rows_of_all_kinds(spark):
    rows = [(1, "el gato come", "es", "x"), (2, "der hund isst", "de", "x"), (3, None, "es", "y"), (4, "gato", None, "y"), (4, "gato", None, "y"), (None, "hund", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.learn(docs, F.lit(True))
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert {(r.text, r.language.lang_pred) for r in got} == {("el gato come", "es"), ("der hund isst", "de"), (None, "und"), ("gato", "es"), ("hund", "de")}
    nothing = language.learn(docs.where("false"), F.lit(True))
    assert {r.language.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).collect() == []


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = op3_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.lang]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_copies_take_no_places_in_the_sample(spark):
    texts = [("es", f"gato{chr(97 + i)} come") for i in range(20)] * 200 + [("de", f"hund{chr(97 + i % 26)}{chr(97 + i // 26)} isst") for i in range(300)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True), per_language=50)
    assert model.languages == ["de", "es"]
    assert sum(w.startswith("gato") for w in model.words.at) == 20 and sum(w.startswith("hund") for w in model.words.at) == 50


def test_texts_of_no_learnt_language_do_not_fit(spark):
    stems = {"es": ("gato", "come", "casa", "perro", "mesa"), "de": ("hund", "isst", "haus", "katze", "tisch")}
    rows = [(lang, " ".join(words[(i + j * j) % 5] for j in range(5 + i))) for lang, words in stems.items() for i in range(20)]
    foreign = ["яблоко лежит на столе " * n for n in (1, 10, 300)] + ["qxv zzkj wqpt " * n for n in (1, 10, 300)]
    docs = spark.createDataFrame([*rows, *((None, t) for t in foreign)], "lang string, text string")
    for usable in (F.lit(True), F.col("lang") == "es"):
        got = language.identify(docs, language.learn(docs, usable)).collect()
        assert not any(r.language.fits for r in got if r.lang is None)
        assert all(r.language.fits for r in got if r.lang == "es")
    assert language.grams_of("ab", 1) == ["a", "b"]


def test_learning_takes_no_more_jobs_for_more_partitions(spark):
    docs = spark.createDataFrame([(w * 3, lang) for lang, w in (("es", "gato "), ("de", "hund "))] * 4, "text string, lang string")
    kept, jobs = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.sparkContext.setJobGroup(f"learn {n}", "")
            assert language.learn(docs, F.lit(True)).languages == ["de", "es"]
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"learn {n}")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
