import os
import random

import corpus_pipeline as p
from tests.llm.test_decontaminate import brute as find
from tests.llm.test_simhash import brute as groups
from twinsift.llm import quality


def write(spark, folder):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(30, 90)), "en", f"s{i % 3}", 1) for i in range(150)]
    labels = []
    for i in range(150):
        if i % 5 == 0:
            rows[i] = (i, rows[i][1] + " awful scum", *rows[i][2:])
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, rows[1][1] + " awful scum", "en", "s0", 1) for i in range(3)]
    rows += [(210 + i, rows[2][1], "en", "s0", 1) for i in range(5)] + [(220, rows[3][1] + " w1", "en", "s0", 1)]
    item = say(20)
    rows += [(230 + i, say(20) + " " + item + " " + say(20), "en", "s1", 1) for i in range(3)] + [(240, None, None, None, None)]
    os.makedirs(folder, exist_ok=True)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return rows, [(1, item)]


def test_stages_against_plain_versions(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows, items = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    good = {r["doc_id"] for r in quality.select(docs, model).collect() if r["kept"]}
    toxic = {r[0] for r in rows if r[1] and "awful" in r[1]}
    assert not good & toxic and len(good) > 0.95 * (len(rows) - len(toxic))
    rows = [r for r in rows if r[0] in good]
    first = {i for i, _, c in groups(rows) if i == c}
    rows = [r for r in rows if r[0] in first]
    clean = {r[0] for r in find(rows, items) if not r[5]}
    assert not clean & {230, 231, 232}
    packed = p.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == clean


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
