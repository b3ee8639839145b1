import os
import tempfile

from equilens.operators import vectorize as vz
from equilens.streaming.folder import score_folder_stream
from tests.fixture_texts import TEXTS


def run_available(stream, query_name, checkpoint):
    """Process what is in the folder into an in-memory table and stop."""
    q = (stream.writeStream.format("memory").queryName(query_name).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def test_folder_stream_scores_new_files(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS.values())], "doc_id long, text string")
    vocab, qw = vz.fit_corpus(docs, vz.query_from_text(spark, "python pandas sql nlp"))
    folder = tempfile.mkdtemp(prefix="equilens-stream-")
    for name in list(TEXTS)[:3]:
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(TEXTS[name])
    stream = score_folder_stream(spark, folder, vocab, qw)
    run_available(stream, "scored_stream", tempfile.mkdtemp(prefix="equilens-stream-ckpt-"))
    rows = {r["Filename"]: r for r in spark.sql("SELECT * FROM scored_stream").collect()}
    assert set(rows) == set(list(TEXTS)[:3])
    batch = vz.weighted_docs(docs, vocab, "text", ["doc_id"])
    from equilens.operators.rank import cosine_score
    want = {i: r["score"] for i, r in enumerate(cosine_score(batch, qw).orderBy("doc_id").collect())}
    for k, name in enumerate(list(TEXTS)[:3]):
        assert rows[name]["score"] == want[k]
        assert rows[name]["Name"] == TEXTS[name].strip().split("\n")[0].strip()
