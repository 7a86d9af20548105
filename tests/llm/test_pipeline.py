import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwise.llm.common import written


def fixture(spark, tmp_path):
    """Documents of plain words, with toxic, bad, copied and personal ones among them, and labels."""
    random_ = random.Random(7)
    words = ["".join(random_.choice("abcdeilnorst") for _ in range(random_.randint(2, 9))) for _ in range(300)]
    rows, labels, toxic, bad = [], [], set(), set()
    for i in range(500):
        text = [random_.choice(words) for _ in range(random_.randint(20, 60))]
        if i % 6 == 1:
            toxic.add(i)
            for _ in range(3):
                text.insert(random_.randint(0, len(text)), random_.choice(["vilexor", "vilexima"]))
        elif i % 7 == 2:
            bad.add(i)
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0, float(i)))
        labels.append((i, int(i not in bad), int(i in toxic)))
    copies = [i for i in range(500) if i not in toxic and i not in bad][:20]
    near = [(600 + i, rows[i][1] + " tail", "en", "s1", 0, 0.0) for i in copies]
    more = [(700, "write to a.b@mail.org or +1 (988) 555-2485 now", None, None, 0, 0.0), (701, None, "en", "s1", 0, 0.0), (702, "", "en", "s1", 0, 0.0), (703, " ".join(words * 200), "en", "s2", 0, 0.0)]
    rows = [*rows, *near, *more, more[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, toxic, bad, copies


def test_stages(spark, tmp_path):
    folder, toxic, bad, copies = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        kept[name] = {r.doc_id for r in docs.collect()}
    everything = {*range(500), *(600 + i for i in copies), 700, 701, 702, 703}
    assert everything - kept["toxicity"] == toxic
    assert kept["toxicity"] - kept["quality"] == bad
    assert {600 + i for i in copies} <= kept["quality"] - kept["near_copies"]
    assert kept["personal_data"] == kept["near_copies"] and docs.where("doc_id = 700").count() == 1
    assert docs.where("doc_id = 700").first().text == "write to [EMAIL] or [PHONE] now"
    assert docs.where("n_chars != char_length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        own = sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start)
        ids = [i for p in own for i in memoryview(bytes(p.ids)).cast("I")]
        assert ids == [*library.encode(r.text or "", add_special_tokens=False).ids, 0]


def test_labels_of_one_class_or_none_drop_nothing(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some plain words").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    cases = {
        "empty": "id < 0", "all_ones": "id >= 0", "all_zeros": "id >= 0", "others": "id >= 0", "unlabelled": "id >= 0",
        "held_out": "crc32(cast(cast(id as string) as binary)) % 4 = 2",
    }
    for name, kept in cases.items():
        key = F.col("id") + (1000 if name == "others" else 0)
        value = {"unlabelled": F.lit(None), "all_ones": F.lit(1), "all_zeros": F.lit(0)}.get(name, F.col("id") % 2).cast("int")
        labels = spark.range(40).where(kept).select(key.alias("doc_id"), value.alias("quality"), value.alias("toxic"))
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == 40, name
        assert corpus_pipeline.keep_good(spark, docs, f"{tmp_path}/{name}").count() == 40, name


def test_empty_tables(spark, tmp_path):
    folder, *_ = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
