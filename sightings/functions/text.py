"""Texts of messages, labels and names as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightings.functions.columns import as_column

# How a camera's place is worded; others read "near {cam}".
PLACES = {
    "driveway": "in driveway",
    "garage": "in garage",
    "shed": "in front of garage",
    "garage-r": "in front of left garage",
    "garage-l": "in front of right garage",
}


def location_phrase(cam: Column | str, places: dict[str, str] = PLACES) -> Column:
    cam = as_column(cam)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(places.items())])
    return F.coalesce(F.try_element_at(known, cam), F.concat(F.lit("near "), cam))


def location_message(tags: Column | str, cam: Column | str) -> Column:
    """`"dog,person near deck"`; tags sorted."""
    return F.concat_ws(
        " ", F.array_join(F.array_sort(as_column(tags)), ","), location_phrase(cam)
    )


def duration_text(seconds: Column) -> Column:
    """Rough duration in its largest unit: seconds, minutes, hours or days."""
    s = F.floor(seconds)

    def unit(n: Column, one: str, many: str) -> Column:
        return F.when(n == 1, F.lit(one)).otherwise(F.concat(n.cast("string"), F.lit(" " + many)))

    return (
        F.when(s < 60, unit(s, "a second", "seconds"))
        .when(s < 3600, unit(F.floor(s / 60), "minute", "minutes"))
        .when(s < 86_400, unit(F.floor(s / 3600), "an hour", "hours"))
        .otherwise(unit(F.floor(s / 86_400), "a day", "days"))
    )


def departure_text(tag: Column, cam: Column, age: Column, seconds: Column) -> Column:
    return F.concat(
        tag,
        F.lit(" departed from "),
        cam,
        F.lit(" after being seen "),
        age.cast("string"),
        F.lit(" times over the past "),
        duration_text(seconds),
    )


def fixed(x: Column, places: int) -> Column:
    """`x` (not negative) with a fixed number of places, from its exact binary value.

    Ties go to the even digit. The built-in formatting rounds the shortest decimal text
    instead and sends ties up, which differs for values such as 0.625. The fraction is taken
    in units of 2^-60, as two halves of 30 bits, so all steps are exact in whole numbers.
    """
    low = (1 << 30) - 1
    scale = 10**places
    whole = F.floor(x)
    bits = ((x - whole) * float(1 << 60)).cast("long")
    b = bits.bitwiseAND(F.lit(low)) * scale
    a = F.shiftright(bits, 30) * scale + F.shiftright(b, 30)
    digits = F.shiftright(a, 30)
    rest = F.shiftleft(a.bitwiseAND(F.lit(low)), 30) + b.bitwiseAND(F.lit(low))
    half = F.lit(1 << 59)
    up = (rest > half) | ((rest == half) & (digits % 2 == 1))
    all_digits = whole * scale + digits + F.when(up, F.lit(1)).otherwise(F.lit(0))
    return F.concat(
        F.floor(all_digits / scale).cast("string"),
        F.lit("."),
        F.lpad((all_digits % scale).cast("string"), places, "0"),
    )


def _part(name: str, value: Column) -> Column:
    return F.concat(F.lit(name), value)


def detection_label(
    tag: Column,
    prob: Column,
    iou: Column,
    ignore: Column,
    priority: Column,
    priority_type: Column,
    age: Column,
) -> Column:
    """`tag:0.93:iou=0.71:ignore=..:p=..:pt=..:age=..` without the parts that are null."""
    return F.concat_ws(
        ":",
        tag,
        fixed(prob, 2),
        F.when(iou.isNotNull(), _part("iou=", fixed(iou, 2))),
        _part("ignore=", ignore),
        _part("p=", priority.cast("string")),
        _part("pt=", priority_type),
        _part("age=", age.cast("string")),
    )


def percent_label(tag: Column | str, prob: Column | str) -> Column:
    share = fixed(as_column(prob) * 100, 1)
    return F.concat(as_column(tag), F.lit(" "), share, F.lit("%"))


def underscored(name: Column | str) -> Column:
    return F.replace(as_column(name), F.lit(" "), F.lit("_"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def strip_extension(name: Column | str) -> Column:
    """Drop the last extension; leading dots belong to the name."""
    return F.regexp_replace(as_column(name), r"^(\.*[^.].*)\.[^.]*$", "$1")


def short_camera_name(uri: Column | str) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(as_column(uri), F.lit("HOST")), F.lit("")))
    return F.replace(F.replace(host, F.lit("-cam.home"), F.lit("")), F.lit(".home"), F.lit(""))


def review_link(
    base: Column, file: Column, model: Column, cam: Column, tags: Column
) -> Column:
    """Link to flag a frame; tags are sorted and without repeats."""
    return F.concat(
        base,
        F.lit("?file="),
        file,
        F.lit("&model="),
        model,
        F.lit("&cam="),
        underscored(cam),
        F.lit("&tags="),
        F.array_join(F.array_sort(F.array_distinct(tags)), ","),
    )


def sighting_name(ts: Column, cam: Column, tags: Column, suffix: Column | None = None) -> Column:
    """`HHmmss-cam-tags`, with `-departed` or `-prior` where given."""
    parts = [
        F.date_format(ts, "HHmmss"),
        underscored(cam),
        F.array_join(F.array_sort(tags), "_"),
    ]
    return F.concat_ws("-", *parts, *([suffix] if suffix is not None else []))
