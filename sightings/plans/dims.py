"""Small configuration tables, written once as rows and rendered as inline VALUES."""

from __future__ import annotations

# Documented names, road lines and regions of the example set-up.
CAMS = [
    "driveway", "garage", "shed", "garage-l", "garage-r", "front entry", "deck", "peach tree",
    "mailbox", "cam9", "cam10", "cam11", "cam12", "cam13", "cam14",
]
TAGS = [
    "person", "vehicle", "dog", "cat", "deer", "package", "fox", "coyote", "raccoon", "person",
]
ROADS = {
    "driveway": "0:0.5, 1.0:0.2",
    "peach tree": "0:0.31, 0.651:0.348, 1.0:0.479",
    "mailbox": "all",
}
RULES = [
    ("garage-l", 1, "vehicle,person", 0.24, 0.8, None, "neighbor", False),
    ("garage-l", 2, "vehicle,person", 0.24, None, None, "road", True),
    ("front entry", 1, "package", None, None, 0.178125, "in grass", False),
]

PUBLISH = ["person,vehicle,dog,package", "person,cat,deer", "", "fox,coyote,package,person"]


def _cameras():
    for i, cam in enumerate(CAMS):
        interval = 30 if i % 4 else 45
        yield (cam, i, interval, i % 2 == 0, ROADS.get(cam), PUBLISH[i % 4])


def _box(cam_no: int, bd: int, grp: int, step: int):
    left = ((bd * 37 + grp * 11 + cam_no * 5) % 40) / 64 + step / 512
    top = ((bd * 23 + grp * 7 + cam_no * 3) % 40) / 64
    return left, top, (8 + (grp + bd) % 8) / 64, (8 + (grp * 3 + bd) % 8) / 64


def _excludes():
    for i, cam in enumerate(CAMS):
        grp = i % 3
        tag = TAGS[(i * 5 + grp) % 10]
        yield (cam, "*", 0, *_box(i, 0, grp, 3), "tree" if i % 2 else None)
        yield (cam, tag, 0, *_box(i, 0, grp, 5), None if i % 3 else "parked")
        yield (cam, tag, 1, *_box(i, 1, grp, 2), "post")


DIMS = {
    "cameras_t": ("cam cam_no interval_s vehicle_check road publish", list(_cameras())),
    "excludes_t": ("cam tag ord l t w h comment", list(_excludes())),
    "rules_t": (
        "cam ord tags max_bottom min_left max_center_x ignore rename_road", RULES,
    ),
    "thresholds_t": (
        "tag min_prob",
        [("person", 0.5), ("vehicle", 0.6), ("dog", 0.55), ("deer", 0.7), ("package", 0.45)],
    ),
    "priorities_t": (
        "mode tag priority",
        [
            (None, "person", 0), (None, "vehicle", -1), (None, "dog", -1), (None, "cat", -2),
            (None, "raccoon", -3), (None, "package", 0), ("night", "person", 1),
            ("night", "fox", 0), ("night", "cat", -3), ("home", "person", -3),
            ("home", "vehicle", -2), ("away", "vehicle", 0), ("away", "deer", -2),
        ],
    ),
    "sounds_t": (
        "tag sound", [("departed", "falling"), ("dog", "bark"), ("person", "siren")],
    ),
    "icons_t": ("tag icon", [("person", "mdi:walk"), ("vehicle", "mdi:car")]),
    "projects_t": (
        "project_id classes",
        [("animals", "cat,dog,deer,fox"), ("people", "person,dog"), ("goods", "package,vehicle")],
    ),
}
# Type of the columns that a null in some row leaves open.
TYPES = {"max_bottom": "double", "min_left": "double", "max_center_x": "double"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def values(name: str) -> str:
    """The rows as a VALUES list, the same text for both engines."""
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in DIMS[name][1])


def columns(name: str) -> list[str]:
    return DIMS[name][0].split()
