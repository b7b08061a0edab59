"""What the driver's entry offers of this folder."""

import __spark_entry__
import corpus_pipeline
from parlor.llm.oracles import ORACLES
from parlor.llm.queries import QUERIES


def test_entry_holds_the_queries_and_the_pipeline():
    queries = __spark_entry__.queries()
    assert set(QUERIES) <= set(queries) and queries["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(queries)


def test_stages_are_those_of_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing",
    ]
