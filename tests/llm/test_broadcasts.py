"""What grows with the documents isn't broadcast, as broadcasts go through the driver."""

import re
import time

from docloom.llm import near_dup
from tests.llm.test_dedup import brute_classes, near_copies

DOCS = "doc_id long, text string"


def plans(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


def test_near_duplicates_broadcast_no_growing_table(spark):
    """The planner's size of the bands leaves out the fan-out of explode(): at 0.6 GB it
    took 8 million rows for a table that fits a broadcast."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    rows = near_copies()
    before = plans(spark).keys()
    kept = {r.doc_id for r in near_dup.deduplicate(spark.createDataFrame(rows, DOCS)).collect()}
    time.sleep(1)  # plans are listed by a listener
    own = [p for i, p in plans(spark).items() if i not in before]
    assert any("SortMergeJoin" in p for p in own)
    joins = {(key, kind) for p in own for key, kind in re.findall(r"\) BroadcastHashJoin[^\n]*\nLeft keys \[1\]: \[(\w+)#.*?\nJoin type: (\w+)", p, re.S)}
    # key: bands; a: links and stars; doc_id: texts asked for; outer joins: labels
    assert not [x for x in joins if x[0] in ("key", "a", "doc_id") or x[1] == "LeftOuter"]
    classes = brute_classes(rows, 5, 80, 100)
    assert kept == {i for i, _ in rows if classes[i][1] == i}
