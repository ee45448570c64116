"""Tables of the sightings model, derived by formula from the given event tables.

Only integer arithmetic and fractions of powers of two are used, so every engine gets the
same numbers. Each event is a detection; nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.functions.geometry import parse_road_line, parse_road_mode
from sightings.operators.filters import apply_region_rules, begin, classify_road, with_links
from sightings.operators.state import asof_state, with_mode
from sightings.operators.zones import apply_exclusions
from sightings.plans.dims import CAMS, TAGS, columns, values
from sightings.session import PACKED, prepare

# Start of the archive (2024-01-01 22:30:00 UTC) and seconds between frames.
START_S, STEP_S = 1704148200, 30
# Every 40 frames an outage of 90 minutes, so that tracks expire.
OUTAGE_EVERY, OUTAGE_S = 40, 5400
ENTITIES = [
    "night_mode", "presence", "vehicle_detector", "person_detector", "vacation_mode", "dog_status",
]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark, PACKED)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dim(spark: SparkSession, name: str) -> DataFrame:
    """An inline table; its size is known to the planner, so no hint is needed to broadcast it."""
    prepare(spark, PACKED)
    return spark.sql(f"SELECT * FROM VALUES {values(name)} AS t({', '.join(columns(name))})")


def cameras(spark: SparkSession) -> DataFrame:
    c = dim(spark, "cameras_t")
    return c.select(
        "cam",
        "cam_no",
        "interval_s",
        "vehicle_check",
        F.col("road").alias("road_text"),
        parse_road_mode("road").alias("road_mode"),
        parse_road_line("road").alias("road_line"),
        F.split("publish", ",").alias("publish"),
    )


def excludes(spark: SparkSession) -> DataFrame:
    box = F.struct(
        F.col("l").alias("left"), F.col("t").alias("top"),
        F.col("w").alias("width"), F.col("h").alias("height"),
    )
    return dim(spark, "excludes_t").select("cam", "tag", "ord", box.alias("box"), "comment")


def rules(spark: SparkSession) -> DataFrame:
    d = dim(spark, "rules_t").withColumn("tags", F.split("tags", ","))
    return d.withColumns(
        {c: F.col(c).cast("double") for c in ("max_bottom", "min_left", "max_center_x")}
    )


def projects(spark: SparkSession) -> DataFrame:
    return dim(spark, "projects_t").withColumn("classes", F.split("classes", ","))


def _names(items: list[str]):
    return F.array(*[F.lit(i) for i in items])


def _clock() -> str:
    seconds = f"{START_S} + frame_no * {STEP_S} + (frame_no div {OUTAGE_EVERY}) * {OUTAGE_S}"
    return f"cast(timestamp_seconds({seconds}) as timestamp_ntz)"


def _numbered(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Events with their places; `spread` deals them out first, as a file may be one task's."""
    events = load(spark, sf_dir, "events")
    return (
        (events.repartition("event_id") if spread else events)
        .selectExpr("*", "event_id % 15 as cam_no", "event_id div 15 as seq")
        .selectExpr("*", "seq div 3 as b", "cast(seq % 3 as int) as det_no")
        .selectExpr("*", "b div 8 as grp", "b % 8 as step", "b + b div 12 as frame_no")
        .withColumn("cam", F.get(_names(CAMS), F.col("cam_no").cast("int")))
        .withColumn("frame_id", F.expr("frame_no * 15 + cam_no"))
    )


def detections(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return (
        _numbered(spark, sf_dir, spread)
        .selectExpr(
            "*",
            "if(det_no = 2 and grp % 3 = 0, 0, det_no) as bd",
            "if((b * 7 + cam_no + det_no) % 11 = 0, 1, 0) as jump",
            "cast((cam_no * 5 + (det_no % 2) * 3 + grp) % 10 as int) as tag_id",
            f"{_clock()} as frame_ts",
        )
        .withColumn("tag", F.get(_names(TAGS), F.col("tag_id")))
        .selectExpr(
            "frame_id", "cam", "frame_no", "frame_ts", "det_no", "tag_id", "tag",
            "((event_id * 73 + user_id * 19) % 128) / 128D as prob",
            "named_struct("
            "'left', ((bd * 37 + grp * 11 + cam_no * 5) % 40) / 64D"
            " + (step + 8 * (det_no - bd)) / 512D,"
            "'top', ((bd * 23 + grp * 7 + cam_no * 3 + jump * 20) % 40) / 64D,"
            "'width', (8 + (grp + bd) % 8) / 64D,"
            "'height', (8 + (grp * 3 + bd) % 8) / 64D) as box",
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the detections, and an empty one after every twelfth."""
    extra = "explode(if(b % 12 = 11, array(0, 1), array(0)))"
    return (
        _numbered(spark, sf_dir)
        .select("cam", "cam_no", "b", "frame_no")
        .distinct()
        .selectExpr("cam", "cam_no", "frame_no as f0", f"{extra} as extra")
        .selectExpr("cam", "cam_no", "f0 + extra as frame_no")
        .selectExpr(
            "frame_no * 15 + cam_no as frame_id", "cam", "frame_no",
            f"{_clock()} as frame_ts",
            "frame_no % 5 = 0 as is_grey",
            "cam = 'cam14' as is_file",
            "concat('/drop/', cam, '/', frame_no, '.jpg') as source",
            "md5(concat(cam, '-', frame_no % 4 div 2)) as hash",
        )
    )


def entity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.get(_names(ENTITIES), F.expr("cast(event_id % 6 as int)"))
    return (
        load(spark, sf_dir, "events")
        .withColumn("entity", entity)
        .selectExpr(
            "entity",
            f"cast(timestamp_millis({START_S}000 + event_id * 667) as timestamp_ntz) as ts",
            "case entity when 'presence' then if(user_id % 2 = 0, 'home', 'away')"
            " when 'dog_status' then if(user_id % 2 = 0, 'inside', 'outside')"
            " else if(user_id % 2 = 0, 'on', 'off') end as state",
        )
    )


def prepared(
    spark: SparkSession, sf_dir: str, linked: DataFrame | None = None, of: DataFrame | None = None
) -> DataFrame:
    """Detections with road, region and exclusion marks, and links to the frames before where those are given.

    `of` are the detections to mark, all where it is not given.
    """
    if linked is None:
        d = detections(spark, sf_dir, spread=True) if of is None else of
    else:
        # Dealt out by frame, which serves the join too.
        d = detections(spark, sf_dir) if of is None else of
        d = d.repartition("frame_id").transform(with_links, linked)
    return (
        d.transform(begin)
        .transform(classify_road, cameras(spark))
        .transform(apply_region_rules, rules(spark))
        .transform(apply_exclusions, excludes(spark))
    )


def frame_states(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """States at each frame; `of` are the frames where they are already written."""
    f = frames(spark, sf_dir) if of is None else of
    f = f.select("frame_id", "cam", "frame_no", "frame_ts")
    return with_mode(asof_state(f, entity_states(spark, sf_dir), ENTITIES))


def known_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(
        "substr(upper(md5(concat('K', c_custkey))), 1, 8) as plate",
        "cast(c_custkey as int) as ord",
        "if(c_custkey % 3 = 0, null, c_name) as owner",
        "if(c_custkey % 4 = 0, null, lower(c_mktsegment)) as color",
        "if(c_custkey % 5 = 0, null, concat('Make', c_nationkey)) as make",
        "if(c_custkey % 2 = 0, null, concat('M', c_custkey % 10)) as model",
        "c_custkey % 7 <> 0 as announce",
    )


def plate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a read of its customer's plate: clean, with errors, or of a stranger."""
    k = known_plates(spark, sf_dir).select("plate", F.col("ord").cast("long").alias("o_custkey"))
    return (
        load(spark, sf_dir, "orders")
        .join(k.hint("merge"), "o_custkey")  # as many rows as customers
        .selectExpr(
            "o_orderkey as read_id",
            "o_custkey",
            "cast(o_orderdate as timestamp_ntz) as ts",
            "case o_orderkey % 5 when 0 then plate"
            " when 1 then concat(substr(plate, 1, 3), 'Z', substr(plate, 4))"
            " when 2 then concat(substr(plate, 1, 5), substr(plate, 7))"
            " when 3 then concat('Q', substr(plate, 2, 3), 'W', substr(plate, 6))"
            " else substr(upper(md5(concat('R', o_orderkey))), 1, 8) end as plate",
        )
    )


def alpr_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per three consecutive read numbers, so a response stays small."""
    item = F.struct("read_id", F.when(F.col("read_id") % 11 != 0, F.col("plate")).alias("plate"))
    return (
        plate_reads(spark, sf_dir)
        .groupBy(F.expr("read_id div 3").alias("response_id"))
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            "response_id",
            F.to_json(
                F.struct(
                    (F.col("response_id") % 13 != 0).alias("success"),
                    F.transform("items", lambda i: F.struct(i["plate"].alias("plate"))).alias(
                        "predictions"
                    ),
                )
            ).alias("body"),
        )
    )


def flag_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a flag request at its place on the archive's clock."""
    return _numbered(spark, sf_dir).selectExpr(
        "event_id",
        f"cast(timestamp_millis({START_S}000 + event_id * 667 - 600000) as timestamp_ntz) as ts",
        "concat(if(event_type = 'error', 'other', 'sightings'), '/',"
        " if(user_id % 9 = 0, 'attic', replace(cam, ' ', '_')),"
        " if(user_id % 2 = 0, '/flag_vehicle/', '/flag_detection/'),"
        " if(event_type = 'signup', 'get', 'set')) as topic",
    )


def capture_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).selectExpr(
        "cam",
        f"cast(timestamp_seconds({START_S} + seq * {STEP_S}) as timestamp_ntz) as ts",
        "event_type not in ('error', 'signup') as ok",
    )


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model candidates: each detection and four shifted, weaker copies, per model."""
    return (
        detections(spark, sf_dir)
        .selectExpr(
            "frame_id", "det_no", "tag_id", "prob", "box", "explode(sequence(0, 4)) as i"
        )
        .selectExpr(
            "frame_id",
            "element_at(array('color', 'grey', 'vehicle'), cast((det_no + i) % 3 + 1 as int))"
            " as model",
            "det_no * 5 + i as box_no",
            "tag_id as class_id",
            "prob - i / 256D as conf",
            "box.left + i / 64D as x1",
            "box.top as y1",
            "box.left + i / 64D + box.width as x2",
            "box.top + box.height as y2",
        )
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid cell per event, four classes; values small and exact before decoding."""
    v = ", ".join(
        f"((event_id * {7 + 6 * k} + user_id * {3 + 2 * k}) % 33 - 16) / 8D" for k in range(9)
    )
    return _numbered(spark, sf_dir).selectExpr(
        "frame_id",
        "cast(event_id % 13 as int) as row",
        "cast(event_id % 11 as int) as col",
        "cast((event_id + det_no) % 5 as int) as anchor",
        "det_no",
        f"array({v}) as v",
    )
