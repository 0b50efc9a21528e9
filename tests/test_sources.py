"""CSV loads and the event stream."""

import json

import pytest
from pyspark.sql import functions as F

from cartwright.operators import quality as dq
from cartwright.schemas import RAW_FILES
from cartwright.sources import files
from cartwright.sources.published import CommitConflict, Published
from cartwright.streaming import events

GOOD = {
    "event_id": "a", "event_type": "order_created", "order_id": 1, "user_id": 2, "order_number": 3, "order_dow": 4,
    "order_hour_of_day": 5, "item_count": 6, "reordered_item_count": 1, "created_at": "2024-01-01T00:00:00+00:00",
}


def messages():
    with_null = GOOD | {"event_id": "b", "item_count": None}
    short = {k: v for k, v in GOOD.items() if k not in ("user_id", "order_id")}
    return [json.dumps(GOOD), json.dumps(with_null), json.dumps(GOOD)[:40], json.dumps(short), "[1, 2]", "7"]


def test_parse_and_dead_letters(spark):
    df = spark.createDataFrame([(m,) for m in messages()], "value string")
    parsed = events.parse_messages(df)
    assert [(r.event_id, r.item_count) for r in events.good_events(parsed).orderBy("event_id").collect()] == [
        ("a", 6), ("b", None)
    ]
    reasons = sorted(r.reason for r in events.dead_letters(parsed).collect())
    assert reasons == ["Invalid JSON event"] * 3 + ["Missing required event fields: order_id, user_id"]


def test_invalid_utf8_is_a_dead_letter(spark):
    df = spark.createDataFrame([(bytearray(b'{"event_id": "\xff"}'),)], "value binary")
    assert events.good_events(events.parse_messages(df)).count() == 0
    assert events.dead_letters(events.parse_messages(df)).count() == 1


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.txt").write_text("\n".join(messages()[:3]))
    table, dead, state = (str(tmp_path / n) for n in ("table", "dead", "state"))

    def run():
        events.write_orders(
            events.file_messages(spark, str(source), files_per_batch=1), table, dead, state, available_now=True
        ).awaitTermination(120)

    run()
    (source / "two.txt").write_text("\n".join(messages()[3:]))
    run()
    run()
    assert events.read_events(spark, table).count() == 2 and events.read_events(spark, dead).count() == 4
    # The same events again, in a new file and after a restart: nothing new but the malformed ones.
    (source / "three.txt").write_text("\n".join([*messages()[:3], json.dumps(GOOD | {"event_id": "c"}), json.dumps(GOOD | {"event_id": None})]))
    run()
    assert sorted(str(r.event_id) for r in events.read_events(spark, table).collect()) == ["None", "a", "b", "c"]
    assert events.read_events(spark, dead).count() == 5


def test_kafka_flushes_by_size_or_time():
    options = events.kafka_options("h:9092", "orders", most=5000)
    assert (options["minOffsetsPerTrigger"], options["maxTriggerDelay"], options["maxOffsetsPerTrigger"]) == ("100", "30s", "5000")


def test_a_batch_is_committed_once_and_whole(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"))
    rows = spark.range(5)
    assert table.append_once(rows, 3) and not table.append_once(rows, 3)
    table.stage(rows)  # written, not committed
    assert table.read_all().count() == 5 and table.remove_unnamed() == 1 and table.read_all().count() == 5


def test_a_failing_load_leaves_the_old_version(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()

    def audit(df):
        return dq.quality_report(dq.null_counts(df, "t", ["id"]))

    good, bad = spark.range(3), spark.createDataFrame([(None,), (9,)], "id long")
    assert table.replace(good, audit) == 3
    with pytest.raises(dq.QualityError, match="id_not_null"):
        table.replace(bad, audit)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        table.replace(good.select((F.col("id") / F.expr("raise_error('zero')")).alias("id")))
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2]
    assert table.append(spark.range(3, 5)) == 2 and table.read().count() == 5
    assert table.replace(spark.range(1)) == 1 and table.read().count() == 1 and table.read(table.manifest(2)["parts"]).count() == 5


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    one, two = (Published(spark, str(tmp_path / "t")) for _ in range(2))
    part = one.stage(spark.range(2))
    one.commit([part], 1)
    with pytest.raises(CommitConflict):
        two.commit([], 1)
    # Rows are those of the write, whoever else appends.
    assert (one.append(spark.range(4)), two.append(spark.range(7))) == (4, 7) and one.read().count() == 13


def test_csv_load(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "orders.csv").write_text(
        "Order-ID,user id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order\n"
        "1,7,prior,1,0,8,\n2,7,train,2,3,9,15.0\n"
    )
    (folder / "order_products__train.csv").write_text("order_id,product_id,add_to_cart_order,reordered\n2,5,1,1\n")
    (folder / "products.csv").write_text('product_id,product_name,aisle_id,department_id\n5,"a, b",1,2\n')
    (folder / "aisles.csv").write_text("aisle_id,aisle\n1,x\n")
    warehouse = str(tmp_path / "warehouse")
    with pytest.raises(FileNotFoundError):
        files.load_dataset(spark, str(folder), warehouse)
    (folder / "departments.csv").write_text("department_id,department\n2,y\n")
    counts = files.load_dataset(spark, str(folder), warehouse)
    assert list(counts) == list(RAW_FILES.values()) and counts["raw_orders"] == 2
    stored = files.read_table(spark, f"{warehouse}/raw_orders").orderBy("order_id").collect()
    assert stored[0].days_since_prior_order is None and stored[1].days_since_prior_order == 15.0
    extra = str(folder / "orders.csv")
    assert files.load_append(spark, extra, f"{warehouse}/all") == 2
    assert files.load_append(spark, extra, f"{warehouse}/all") == 2
    assert files.read_table(spark, f"{warehouse}/all").count() == 4


def test_artifact_sinks(spark, tmp_path):
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "feature string, importance double")
    files.write_importance_csv(shares, str(tmp_path / "importance"))
    files.write_metrics_json(shares.agg(F.sum("importance").alias("total")), str(tmp_path / "metrics"))
    back = spark.read.option("header", True).csv(str(tmp_path / "importance"))
    assert sorted(r.feature for r in back.collect()) == ["a", "b"]
    assert spark.read.json(str(tmp_path / "metrics")).first().total == 0.75
