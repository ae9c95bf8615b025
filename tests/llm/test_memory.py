"""What workers hold at one time, and what they keep after a task."""

from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetscope.llm import encoding
from packetscope.llm.bpe import Vocabulary
from packetscope.llm.common import giving_back
from packetscope.llm.lexicon import compile_lexicon
from packetscope.session import BATCH_BYTES, ship

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limit(spark):
    before = spark.conf.get(LIMIT)
    yield
    spark.conf.set(LIMIT, before)


def test_batches_are_bounded_by_bytes(spark, limit):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    spark.conf.set(LIMIT, str(64 << 20))
    ship(spark)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    sizes = [r.size for r in texts.mapInArrow(run, "size long").collect()]
    assert len(sizes) > 1 and max(sizes) < 1.2 * BATCH_BYTES


def test_a_lower_limit_stays(spark, limit):
    spark.conf.set(LIMIT, "1000000")
    ship(spark)
    assert int(spark.conf.get(LIMIT).rstrip("b")) == 1_000_000


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    said = []
    monkeypatch.setattr("packetscope.llm.common.give_back", lambda: said.append("back"))
    assert list(giving_back(lambda batches: (said.append(b) or b for b in batches))([1, 2])) == [1, 2]
    assert said == [1, 2, "back"]


def test_other_stages_let_an_encoder_go():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = f.read()
    words = {w: Vocabulary.of(file).merge(w) for w in (b" a", b" word")}
    shared = SimpleNamespace(value=(file, compile_lexicon(words)))
    encoder = encoding._encoder(shared)
    assert encoding._encoder(shared) is encoder
    assert list(giving_back(iter)([1, 2])) == [1, 2]
    assert encoding._encoder(shared) is not encoder
