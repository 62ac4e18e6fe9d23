"""One table of everything that may go wrong, through every operator and every stage."""

import hashlib
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprint, jaccard, langid, lmscore, media, mixing, packing, pii, toxicity, urlfilter

LOW, HIGH = -(2**63), 2**63 - 1
ZEROS = "0" * 5000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (LOW, f"address {ZEROS}1.2.3.4 and {'9' * 5000}"), (HIGH, "word " * 30000), (HIGH - 1, "same text here for all of us"), (LOW + 1, "Same text here for all of us"),
    (7, "same text here for all of us"), (7, "same text here for all of us"), (7, "another text that shares the number"), (8, "日本語 STRASSE straße ﬁ\x00 ΟΔΟΣ"), (9, "x" * 200_000), (10, "a@b.c " * 2000),
    (None, "no number"), (None, "no number"), (None, None), (11, "\U0001f600 <|endoftext|> ’‘"), (12, "the end of the table, more or less"),
]
#: Names that some operator or stage uses inside, as columns of other kinds.
NAMES = """row rank bucket shelf c n units period slot release deadline block position place turn since nth idle source_ stretch hash outer bounds band head following below near lower
top highest canon h1 h2 fingerprint component component_id sig cluster level token tokens places reach leader members count first id lost first_sig file offset before number start length ids_crc32
doc_tokens _deal _group sequence_id score score_ toxicity __toxicity _toxic features held_out lang_pred lang_score lang_rejected seen _share spans base chunk keys counts totals rows part n_words
log_sum digest twins class_id a b matches at best _file _row _place __row a.b _metadata""".split()


def documents(spark, rows=TEXTS):
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, [None, "s", "s", "t"][k % 4], "many") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars string")
    return docs.select("*", *(F.lit(k).alias(name) if k % 2 else F.lit(name).alias(name) for k, name in enumerate(NAMES)))


def plain(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*(F.col(f"`{c}`") for c in columns)).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, k % 2) for k, (i, _) in enumerate(TEXTS)] + [(None, 1), (1, None), (7, 0), (7, 1)]
    return spark.createDataFrame(rows, "doc_id long, toxic int").withColumns({"text": F.lit("label"), "_toxic": F.lit("x"), "features": F.lit(1)})


def test_urls(spark):
    pages = spark.createDataFrame([(i, t) for i, t in TEXTS] + [(5, f"http://{'h' * 100_000}.org/{'?' * 5000}"), (6, "://"), (6, "http://EXAMPLE.org/es/")], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit(1), "features": F.lit(2), "rule": F.lit(3), "block_probability": F.lit("x"), "label": F.lit("y")})
    out = urlfilter.judge(pages, urlfilter.fit_frames(pages))
    assert out.count() == len(TEXTS) + 3 and out.where("verdict NOT IN ('allow', 'block')").count() == 0
    assert out.where("rule = 'example.org/es/' AND verdict = 'block'").count() == 1
    assert urlfilter.judge(pages.where("false"), urlfilter.fit([])).count() == 0


def test_personal_data(docs):
    out = pii.find(docs)
    assert out.count() == len(TEXTS) and out.where(F.col("doc_id") == LOW).first().base == f"ip:8:{8 + 5007}"
    masked = pii.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(TEXTS)
    assert plain(masked, "doc_id", "n_chars", *NAMES) == plain(docs, "doc_id", "n_chars", *NAMES)


def test_packing(docs):
    rows = packing.pack(docs).collect()
    tokens = packing.encoder(packing._vocabulary_path()).tokenizer
    want = sorted((str(i), len(tokens.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in TEXTS)
    got = sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0)
    assert got == want and sum(r.length for r in rows) == sum(n for _, n in want)


def test_mixing(docs):
    out = mixing.schedule(docs, {"s": 0.75, "t": 0.25})
    assert out.count() == len(TEXTS) and out.select("position").distinct().count() == len(TEXTS)
    assert out.where("source IS NULL AND release IS NOT NULL").isEmpty()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and plain(mixed, "doc_id", "text", *NAMES) == plain(docs, "doc_id", "text", *NAMES)


def test_toxicity_and_language(docs, labels):
    model = toxicity.fit_frames(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == len(TEXTS) and out.where("toxicity < 0 OR toxicity > 1 OR toxicity IS NULL").isEmpty()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    found = langid.identify(docs, langid.fit_frames(docs))
    assert found.count() == len(TEXTS) and found.where("lang_score IS NULL").isEmpty()
    assert {r.lang_pred for r in found.where("text IS NULL OR text = ''").collect()} == {"und"}


def test_fingerprints(docs):
    rows = fingerprint.fingerprints(docs).collect()
    assert len(rows) == len(TEXTS)
    of = {i: r.fingerprint for i, _ in TEXTS for r in rows if r.doc_id == i}
    assert of[HIGH - 1] == of[LOW + 1] and of[1] == of[2] == of[3] and of[9] != of[10]
    order = sorted({i for i, _ in TEXTS if i is not None}, reverse=True)
    after = order[order.index(HIGH - 1) + 1]
    text = dict(TEXTS)
    half = len(text[HIGH - 1]) // 2
    edited = text[HIGH - 1][: len(text[HIGH - 1]) - half] + (text[after] or "")[:half]
    assert next(r for r in rows if r.doc_id == HIGH - 1).edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_scores_and_links(docs):
    scores = lmscore.lm_scores(docs).collect()
    assert len(scores) == len(TEXTS) and all(r.score <= 0 for r in scores)
    groups = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.linked_groups(docs).collect()}
    assert groups[7, 3] == groups[HIGH - 1, 3] == LOW + 1
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [str(r.text).lower() for r in kept.collect()]
    assert texts.count("same text here for all of us") == 1 and texts.count("no number") == 1 and texts.count("none") == 2


def test_images(spark):
    image = media.picture([float(k % 7) - 3 for k in range(64)])
    rows = [(LOW, image), (HIGH, image), (5, None), (5, b""), (6, b"P5 1 1 255\nx"), (None, image), (7, b"P5 99999 99999 255\n"), (8, media.encode_pgm(media.np.zeros((60, 60))))]
    table = spark.createDataFrame(rows, "id long, image binary").withColumns({"ref": F.lit("x"), "bucket": F.lit("y"), "digest": F.lit(1), "first": F.lit(2)})
    classes, answers = media.find_copies(table, table)
    found = classes.collect()
    assert len(found) == 7 and {r.class_id for r in found if r.id in (LOW, HIGH)} == {LOW}
    assert {r.id: r.class_id for r in answers.collect()} == {LOW: LOW, HIGH: LOW}


def test_every_stage(spark, docs, labels, tmp_path):
    folder = f"{tmp_path}/tables"
    documents(spark).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        stage(spark, rows, folder).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert rows.columns == before.columns, name
    assert rows.where("start = 0").count() == before.count() > 0
    assert {zlib.crc32(b"\x02\x00\x00\x00")} <= {r.ids_crc32 for r in rows.collect()}  # a null text


def test_every_stage_of_no_rows(spark, docs, labels, tmp_path):
    folder = f"{tmp_path}/tables"
    documents(spark).where("false").write.parquet(f"{folder}/documents.parquet")
    labels.where("false").write.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, folder).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        assert rows.count() == 0
