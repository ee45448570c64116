"""Plain-Python models of the order-dependent operators, written from their rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1, 20, 0, 0)


def iou(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    inter = w * h
    whole = a[2] * a[3] + b[2] * b[3] - inter
    return inter / whole if whole else 0.0


def track_model(frames, dets, interval):
    """frames: (frame_id, cam, ts) in order; dets: frame_id -> list of (det_no, tag, box).

    Returns (rows per detection, departures).
    """
    tracks, rows, gone = {}, {}, []
    for frame_id, cam, now in frames:
        born = []
        for det_no, tag, box in dets.get(frame_id, []):
            live = tracks.setdefault((cam, tag), [])
            hit = None
            for t in live:
                o = iou(t["box"], box)
                if o > 0.5:
                    t["box"], t["last"], t["age"] = box, now, t["age"] + 1
                    hit = (t, o, t["age"])
            if hit is None:
                t = {
                    "id": f"{cam}|{tag}|{frame_id}|{det_no}", "box": box, "start": now,
                    "last": now, "age": 0, "cam": cam, "tag": tag,
                }
                live.append(t)
                born.append(((frame_id, det_no), t))
            else:
                rows[frame_id, det_no] = (hit[0]["id"], hit[1], hit[2], False, box)
        for key, t in born:
            rows[key] = (t["id"], None, t["age"], True, t["box"])
        for (c, _), live in tracks.items():
            if c != cam:
                continue
            for t in list(live):
                ttl = timedelta(minutes=min(1 + t["age"] * interval[cam] / 60, 60))
                if t["last"] < now - ttl:
                    live.remove(t)
                    gone.append((t, now))
    out = [(t["id"], t["start"], t["last"], t["age"], at) for t, at in gone]
    for live in tracks.values():
        out += [(t["id"], t["start"], t["last"], t["age"], None) for t in live]
    return rows, out


def random_archive(seed, cams=4, n=400, gap=(5, 60), outage=0.01, empty=0.2):
    """Frames and detections with parked, drifting and jumping boxes, copies and outages."""
    rng = random.Random(seed)
    frames, dets, interval = [], {}, {}
    next_id = 0
    for c in range(cams):
        cam = f"c{c}"
        interval[cam] = rng.choice([10, 30, 45])
        ts = T0 + timedelta(seconds=rng.randrange(600))
        things = [
            [rng.choice(["car", "cat"]), rng.randrange(40) / 64, rng.randrange(40) / 64,
             rng.randrange(6, 16) / 64, rng.randrange(6, 16) / 64, rng.choice([0, 0, 1])]
            for _ in range(rng.randrange(1, 5))
        ]
        for _ in range(n):
            ts += timedelta(seconds=rng.randrange(*gap))
            if rng.random() < outage:
                ts += timedelta(seconds=rng.randrange(1800, 9000))
            next_id += 1
            frames.append((next_id, cam, ts))
            if rng.random() < empty:
                continue
            found = []
            for th in things:
                if rng.random() < 0.3:
                    continue
                if th[5]:
                    th[1] += rng.choice([-2, -1, 0, 1, 2]) / 64
                if rng.random() < 0.02:
                    th[1], th[2] = rng.randrange(40) / 64, rng.randrange(40) / 64
                box = (th[1], th[2], th[3], th[4])
                found.append((th[0], box))
                if rng.random() < 0.15:
                    found.append((th[0], (th[1] + rng.choice([0, 1, 3]) / 64, *box[1:])))
            dets[next_id] = [(i, tag, box) for i, (tag, box) in enumerate(found)]
    frames.sort(key=lambda f: (f[2], f[0]))
    return frames, dets, interval
