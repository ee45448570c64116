"""Box and line geometry as column expressions. Boxes are fractions of the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.functions.columns import as_column, first_of, let

# Anchor sizes (width, height) of the grid model, in grid cells.
ANCHORS = [(0.573, 0.677), (1.87, 2.06), (3.34, 5.47), (7.88, 3.53), (9.77, 9.17)]


def make_box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(
        left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height")
    )


def box_center(box: Column) -> Column:
    return F.struct(
        (box["left"] + box["width"] / 2).alias("x"), (box["top"] + box["height"] / 2).alias("y")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    """Width and height that two boxes have in common, not above 0 where they lie apart."""
    across = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(
        a["left"], b["left"]
    )
    down = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    return across, down


def box_iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two left/top/width/height boxes; 0 for two empty ones."""
    a, b = as_column(a), as_column(b)
    across, down = _common(a, b)
    inter = F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)
    return _ratio(inter, a["width"] * a["height"] + b["width"] * b["height"] - inter)


def box_meets(a: Column | str, b: Column | str) -> Column:
    """Whether `box_iou` is above 0, for less work where boxes lie apart. Sides must be numbers (no NaN)."""
    across, down = _common(as_column(a), as_column(b))
    return (across > 0) & (down > 0)


def box_iou_px(a: Column | str, b: Column | str) -> Column:
    """The same for x1/y1/x2/y2 pixel boxes whose end pixels count."""
    a, b = as_column(a), as_column(b)
    across = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1
    down = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1
    inter = F.greatest(F.lit(0), across) * F.greatest(F.lit(0), down)

    def area(box: Column) -> Column:
        return (box["x2"] - box["x1"] + 1) * (box["y2"] - box["y1"] + 1)

    return _ratio(inter.cast("double"), (area(a) + area(b) - inter).cast("double"))


def corner_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners to left/top/width/height, rounded to 8 places."""
    return make_box(F.round(x1, 8), F.round(y1, 8), F.round(x2 - x1, 8), F.round(y2 - y1, 8))


def parse_road_mode(text: Column | str) -> Column:
    text = as_column(text)
    return F.when(text == "all", "all").when(F.length(text) > 0, "line")


def parse_road_line(text: Column | str) -> Column:
    """`"x:y, x:y"` to an array of points; null for a blank text or `all`."""
    text = as_column(text)
    points = F.transform(
        F.split(text, ","),
        lambda p: F.struct(
            F.trim(F.split_part(p, F.lit(":"), F.lit(1))).cast("double").alias("x"),
            F.trim(F.split_part(p, F.lit(":"), F.lit(2))).cast("double").alias("y"),
        ),
    )
    return F.when(parse_road_mode(text) == "line", points)


def polyline_legs(points: Column | str) -> Column:
    """Legs of a line of points: start and end of each. Worth keeping with the line."""
    points = as_column(points)
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(
        F.slice(points, F.lit(1), n),
        F.slice(points, F.lit(2), n),
        lambda p, q: F.struct(p.alias("p"), q.alias("q")),
    )


def polyline_y(x: Column | str, points: Column | str, legs: Column | str | None = None) -> Column:
    """Height of a line of points at `x`: flat beyond the ends, linear in between.

    `legs` is what `polyline_legs` gives for the points, where it is at hand.
    """
    x, points = as_column(x), as_column(points)
    legs = polyline_legs(points) if legs is None else as_column(legs)
    head, tail = first_of(points), F.try_element_at(points, F.lit(-1))

    def height(s: Column) -> Column:
        p, q = s["p"], s["q"]
        run = q["x"] - p["x"]
        share = F.when(run != 0, (x - p["x"]) / run).otherwise(F.lit(0.0))
        return p["y"] + share * (q["y"] - p["y"])

    over = F.filter(legs, lambda s: (s["p"]["x"] <= x) & (x <= s["q"]["x"]))
    return (
        F.when(x <= head["x"], head["y"])
        .when(x >= tail["x"], tail["y"])
        .otherwise(F.coalesce(first_of(F.transform(over, height)), tail["y"]))
    )


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    small = F.exp(-F.abs(x))
    return F.when(x > 0, 1 / (1 + small)).otherwise(small / (1 + small))


def _extent(df: DataFrame, keys: list[str], margin: float) -> DataFrame:
    box = F.col("box")
    return df.groupBy(*keys).agg(
        F.min(box["left"] - margin).alias("_l"),
        F.max(box["left"] + box["width"] + margin).alias("_r"),
        F.min(box["top"] - margin).alias("_t"),
        F.max(box["top"] + box["height"] + margin).alias("_b"),
    )


def _sized(df: DataFrame, frame_size: tuple[int, int] | None) -> DataFrame:
    """Scale the extent by the frame size: given, or the frame's own columns img_w, img_h."""
    w = F.lit(float(frame_size[0])) if frame_size else F.col("img_w").cast("double")
    h = F.lit(float(frame_size[1])) if frame_size else F.col("img_h").cast("double")
    return df.select(
        "*",
        w.alias("_w"),
        h.alias("_h"),
        (F.col("_l") * w).alias("_x1"),
        (F.col("_r") * w).alias("_x2"),
        (F.col("_t") * h).alias("_y1"),
        (F.col("_b") * h).alias("_y2"),
    )


def alert_crop(
    detections: DataFrame,
    frame_size: tuple[int, int] | None = None,
    keys: tuple[str, ...] = ("frame_id",),
    margin: float = 0.05,
) -> DataFrame:
    """Region of interest of each frame, at least a quarter of it each way.

    The far edges are fitted with the top that is not yet centred; the left is centred
    before that. The order matters and is kept.
    """
    keys = list(keys) + ([] if frame_size else ["img_w", "img_h"])
    d = _sized(_extent(detections, keys, margin), frame_size)
    x1, x2, y1, y2, w, h = (F.col(c) for c in ("_x1", "_x2", "_y1", "_y2", "_w", "_h"))
    d = d.select(
        "*",
        (x1 + (x2 - x1) / 2).alias("_cx"),
        (y1 + (y2 - y1) / 2).alias("_cy"),
        F.greatest(w / 4, x2 - x1).alias("_sw"),
        F.greatest(h / 4, y2 - y1).alias("_sh"),
    )
    d = d.withColumn(
        "crop_left",
        F.greatest(F.lit(0.0), F.least(F.col("_x1"), F.col("_cx") - F.col("_sw") / 2)),
    ).withColumn("_top", F.greatest(F.lit(0.0), F.col("_y1")))
    d = d.withColumn("_sw", F.least(F.col("_sw"), F.col("_w") - F.col("crop_left"))).withColumn(
        "_sh", F.least(F.col("_sh"), F.col("_h") - F.col("_top"))
    )
    d = d.withColumn(
        "crop_top",
        F.greatest(F.lit(0.0), F.least(F.col("_top"), F.col("_cy") - F.col("_sh") / 2)),
    )
    return d.select(
        *keys,
        "crop_left",
        "crop_top",
        (F.col("crop_left") + F.col("_sw")).alias("crop_right"),
        (F.col("crop_top") + F.col("_sh")).alias("crop_bottom"),
    )


def vehicle_crop(
    detections: DataFrame,
    frame_size: tuple[int, int] | None = None,
    keys: tuple[str, ...] = ("frame_id",),
    margin: float = 0.05,
) -> DataFrame:
    """Region of all vehicles not ignored, cut at the frame, where a vehicle is visible.

    `detections` has `tag`, `ignore`, `age` and `departed`.
    """
    keys = list(keys) + ([] if frame_size else ["img_w", "img_h"])
    vehicles = detections.filter((F.col("tag") == "vehicle") & F.col("ignore").isNull())
    box = F.col("box")
    seen = F.max(~F.coalesce(F.col("departed"), F.lit(False)) & (F.col("age") < 3))
    extent = (
        vehicles.groupBy(*keys)
        .agg(
            F.min(box["left"] - margin).alias("_l"),
            F.max(box["left"] + box["width"] + margin).alias("_r"),
            F.min(box["top"] - margin).alias("_t"),
            F.max(box["top"] + box["height"] + margin).alias("_b"),
            seen.alias("_seen"),
        )
        .filter("_seen")
    )
    return _sized(extent, frame_size).select(
        *keys,
        F.greatest(F.lit(0.0), F.col("_x1")).alias("crop_left"),
        F.greatest(F.lit(0.0), F.col("_y1")).alias("crop_top"),
        F.least(F.col("_w"), F.col("_x2")).alias("crop_right"),
        F.least(F.col("_h"), F.col("_y2")).alias("crop_bottom"),
    )


def decode_grid(
    cells: DataFrame,
    anchors: list[tuple[float, float]] = ANCHORS,
    grid: tuple[int, int] | None = None,
) -> DataFrame:
    """Raw grid cells (frame_id, row, col, anchor, v) to boxes with class probabilities.

    `v` holds the two offsets, the two log sizes, the objectness and the class logits.
    The grid size is given as (rows, columns) or read from columns grid_h, grid_w.
    """
    rows = F.lit(grid[0]) if grid else F.col("grid_h")
    cols = F.lit(grid[1]) if grid else F.col("grid_w")
    sizes = F.array(*[F.array(F.lit(w), F.lit(h)) for w, h in anchors])
    v = F.col("v")
    size = F.get(sizes, F.col("anchor"))
    d = cells.withColumns(
        {
            "_cx": (sigmoid(F.get(v, F.lit(0))) + F.col("col")) / cols,
            "_cy": (sigmoid(F.get(v, F.lit(1))) + F.col("row")) / rows,
            "_w": F.exp(F.get(v, F.lit(2))) * F.get(size, F.lit(0)) / cols,
            "_h": F.exp(F.get(v, F.lit(3))) * F.get(size, F.lit(1)) / rows,
        }
    )
    logits = F.slice(v, F.lit(6), F.greatest(F.size(v) - 5, F.lit(0)))
    powers = let(
        F.struct(logits.alias("x"), F.array_max(logits).alias("peak")),
        lambda s: F.transform(s["x"], lambda x: F.exp(x - s["peak"])),
    )
    share = sigmoid(F.get(v, F.lit(4)))
    probs = let(
        powers,
        lambda e: let(
            share / F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x),
            lambda k: F.transform(e, lambda x: x * k),
        ),
    )
    return d.select(
        "frame_id",
        "row",
        "col",
        "anchor",
        make_box(
            F.col("_cx") - F.col("_w") / 2, F.col("_cy") - F.col("_h") / 2, F.col("_w"), F.col("_h")
        ).alias("box"),
        probs.alias("probs"),
    )
