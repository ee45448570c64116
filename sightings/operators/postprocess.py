"""From raw model output to detections: non-maximum suppression and label lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.functions.columns import let
from sightings.functions.geometry import corner_box, make_box
from sightings.session import ship

# Fixed values of the two models: confidence, overlap and detections per frame.
CONFIDENCE, OVERLAP = 0.4, 0.6
GRID_CONFIDENCE, GRID_OVERLAP, MAX_DETECTIONS = 0.10, 0.45, 20


def best_class(raw: DataFrame) -> DataFrame:
    """Highest class confidence of each box and its class, the first on ties (`confs` array)."""
    peak = F.array_max("confs")
    return raw.withColumns(
        {"conf": peak, "class_id": (F.array_position(F.col("confs"), peak) - 1).cast("int")}
    )


def _overlap(a: Column, b: Column, min_mode: bool) -> Column:
    across = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    down = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    whole = F.least(area(a), area(b)) if min_mode else area(a) + area(b) - inter
    # Two boxes without area: not a number, which is not under any limit.
    return F.when(whole != 0, inter / whole).otherwise(F.lit(float("nan")))


def nms(
    raw: DataFrame, conf: float = CONFIDENCE, iou: float = OVERLAP, min_mode: bool = False
) -> DataFrame:
    """Greedy suppression per frame, model and class, strongest box first (ties: box_no).

    raw: frame_id, model, box_no, class_id, conf, x1, y1, x2, y2. A group is what one model
    found of one class in one frame. det_no numbers a frame's boxes by class, then strength.
    """
    item = F.struct((-F.col("conf")).alias("rank"), "box_no", "x1", "y1", "x2", "y2")
    groups = (
        raw.filter(F.col("conf") > conf)
        .groupBy("frame_id", "model", "class_id")
        .agg(F.array_sort(F.collect_list(item)).alias("_boxes"))
    )
    kept = F.aggregate(
        "_boxes",
        F.slice("_boxes", F.lit(1), F.lit(0)),
        lambda acc, b: F.when(
            F.exists(acc, lambda k: ~(_overlap(k, b, min_mode) <= iou)), acc
        ).otherwise(F.concat(acc, F.array(b))),
    )
    frames = groups.withColumn("_kept", kept).groupBy("frame_id", "model")
    listed = frames.agg(
        F.array_sort(
            F.collect_list(F.struct("class_id", F.col("_kept").alias("kept")))
        ).alias("_classes")
    )
    flat = F.flatten(
        F.transform(
            "_classes",
            lambda c: F.transform(
                c["kept"], lambda b: F.struct(c["class_id"].alias("class_id"), b.alias("b"))
            ),
        )
    )
    b = F.col("_r")["b"]
    return listed.select("frame_id", "model", F.posexplode(flat).alias("det_no", "_r")).select(
        "frame_id",
        "model",
        "det_no",
        b["box_no"].alias("box_no"),
        F.col("_r")["class_id"].alias("tag_id"),
        F.round(-b["rank"], 8).alias("prob"),
        corner_box(b["x1"], b["y1"], b["x2"], b["y2"]).alias("box"),
    )


def nms_boxes(
    boxes: Column, conf: float = CONFIDENCE, iou: float = OVERLAP, min_mode: bool = False
) -> Column:
    """The same over one frame's array of boxes, without a shuffle; so it serves on a stream too.

    boxes: array of (model, box_no, class_id, conf, x1, y1, x2, y2). The result is an array of
    (model, det_no, box_no, tag_id, prob, box), ordered by model and det_no; a null array gives
    an empty one.
    """
    place = ("model", "class_id", "rank", "box_no")

    def item(b: Column) -> Column:
        own = {c: b[c] for c in ("model", "class_id", "box_no", "x1", "y1", "x2", "y2")} | {"rank": -b["conf"]}
        return F.struct(*[own[c].alias(c) for c in (*place, "x1", "y1", "x2", "y2")])

    boxes = F.coalesce(boxes, F.array())
    found = F.array_sort(F.transform(F.filter(boxes, lambda b: b["conf"] > conf), item))

    def step(acc: Column, b: Column) -> Column:
        same = lambda k: (k["model"] == b["model"]) & (k["class_id"] == b["class_id"])
        hidden = F.exists(acc, lambda k: same(k) & ~(_overlap(k, b, min_mode) <= iou))
        return F.when(hidden, acc).otherwise(F.concat(acc, F.array(b)))

    def numbered(kept: Column) -> Column:
        def row(b: Column, i: Column) -> Column:
            before = F.filter(F.slice(kept, F.lit(1), i), lambda k: k["model"] == b["model"])
            return F.struct(
                b["model"].alias("model"), F.size(before).alias("det_no"), b["box_no"].alias("box_no"),
                b["class_id"].alias("tag_id"), F.round(-b["rank"], 8).alias("prob"),
                corner_box(b["x1"], b["y1"], b["x2"], b["y2"]).alias("box"),
            )

        return F.transform(kept, row)

    kept = let(found, lambda x: F.aggregate(x, F.slice(x, F.lit(1), F.lit(0)), step))
    return let(kept, numbered)


def _suppress(boxes, probs, floor: float, overlap: float, limit: int):
    """Indices, classes and confidences chosen from one frame."""
    area = boxes[:, 2] * boxes[:, 3]
    right, bottom = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
    chosen = []
    for _ in range(min(limit, len(boxes))):
        flat = int(probs.max(axis=1).argmax())
        kind = int(probs[flat].argmax())
        value = float(probs[flat, kind])
        if value < floor:
            break
        chosen.append((flat, kind, value))
        w = np.minimum(right, right[flat]) - np.maximum(boxes[:, 0], boxes[flat, 0])
        h = np.minimum(bottom, bottom[flat]) - np.maximum(boxes[:, 1], boxes[flat, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        whole = area + area[flat] - inter
        hit = np.divide(inter, whole, out=np.zeros_like(inter), where=whole != 0) > overlap
        hit[flat] = True
        probs[hit, kind] = 0.0
    return chosen


def nms_suppress(
    raw: DataFrame,
    prob: float = GRID_CONFIDENCE,
    iou: float = GRID_OVERLAP,
    max_det: int = MAX_DETECTIONS,
) -> DataFrame:
    """Suppression that only zeroes the chosen class: a box may win again as another class.

    raw: frame_id, box_no, box, probs. Boxes are gathered per frame (one frame's candidates),
    and a batch of frames goes to Python at a time.
    """
    ship(raw.sparkSession)
    box = F.col("box")
    item = F.struct(
        (-F.array_max("probs")).alias("rank"),
        "box_no",
        F.array(box["left"], box["top"], box["width"], box["height"]).alias("b"),
        F.col("probs").alias("p"),
    )
    frames = (
        raw.filter(F.array_max("probs") > prob)
        .groupBy("frame_id")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(
            "frame_id",
            F.transform("_items", lambda i: i["b"]).alias("boxes"),
            F.transform("_items", lambda i: i["p"]).alias("probs"),
            F.transform("_items", lambda i: i["box_no"]).alias("nos"),
        )
    )

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for frame, boxes, probs, nos in zip(pdf.frame_id, pdf.boxes, pdf.probs, pdf.nos):
                b, p = np.stack(list(boxes)), np.stack(list(probs)).astype(float)
                for n, (i, kind, value) in enumerate(_suppress(b, p, prob, iou, max_det)):
                    rows.append((frame, n, int(nos[i]), kind, value, *b[i]))
            yield pd.DataFrame(
                rows,
                columns=["frame_id", "det_no", "box_no", "tag_id", "prob", "l", "t", "w", "h"],
            )

    found = frames.mapInPandas(
        pick,
        "frame_id long, det_no int, box_no int, tag_id int, prob double, "
        "l double, t double, w double, h double",
    )
    r = lambda c: F.round(c, 8)
    return found.select(
        "frame_id",
        "det_no",
        "box_no",
        "tag_id",
        r("prob").alias("prob"),
        make_box(r("l"), r("t"), r("w"), r("h")).alias("box"),
    )


_PICKED = (
    "array<struct<det_no:int,box_no:int,tag_id:int,prob:double,"
    "box:struct<left:double,top:double,width:double,height:double>>>"
)


def suppressed_boxes(
    boxes: Column, prob: float = GRID_CONFIDENCE, iou: float = GRID_OVERLAP, max_det: int = MAX_DETECTIONS
) -> Column:
    """`nms_suppress` over one frame's array of boxes, without a shuffle; so it serves on a stream too.

    boxes: array of (box_no, box, probs). The result is an array of (det_no, box_no, tag_id, prob,
    box) in order; a null array gives an empty one. Batches of frames go to Python at a time.
    """

    @F.pandas_udf(_PICKED)
    def pick(places: pd.Series, probs: pd.Series, nos: pd.Series) -> pd.Series:
        out = []
        for b, p, no in zip(places, probs, nos):
            rows = []
            if b is not None and len(b):
                b, p = np.stack(list(b)), np.stack(list(p)).astype(float)
                for n, (i, kind, value) in enumerate(_suppress(b, p, prob, iou, max_det)):
                    box = dict(zip(("left", "top", "width", "height"), (round(float(x), 8) for x in b[i])))
                    rows.append({"det_no": n, "box_no": int(no[i]), "tag_id": kind, "prob": round(value, 8), "box": box})
            out.append(rows)
        return pd.Series(out)

    def item(i: Column) -> Column:
        b = i["box"]
        place = F.array(b["left"], b["top"], b["width"], b["height"])
        return F.struct((-F.array_max(i["probs"])).alias("rank"), i["box_no"].alias("no"), place.alias("b"), i["probs"].alias("p"))

    kept = F.array_sort(F.transform(F.filter(boxes, lambda i: F.array_max(i["probs"]) > prob), item))
    def part(name: str) -> Column:
        return F.transform(kept, lambda i: i[name])

    return pick(part("b"), part("p"), part("no"))


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Name of each class; a box of an unknown class stays, with tag null and `unknown` set."""
    d = df.join(labels.select("tag_id", "tag"), "tag_id", "left")
    return d.withColumn("unknown", F.col("tag").isNull())
