"""The same results as ANSI-style SQL over the given tables, for DuckDB.

`CTES` are building blocks in dependency order; `ORACLE` has one statement per query.
"""

from __future__ import annotations

import re

from sightings.plans.dims import CAMS, DIMS, TAGS, columns, values
from sightings.plans.fixtures import ENTITIES, OUTAGE_EVERY, OUTAGE_S, START_S, STEP_S
from sightings.plans.queries import THRESHOLD


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _iou(al, at, aw, ah, bl, bt, bw, bh) -> str:
    inter = (
        f"greatest(0.0, least({al}+{aw}, {bl}+{bw}) - greatest({al}, {bl}))"
        f" * greatest(0.0, least({at}+{ah}, {bt}+{bh}) - greatest({at}, {bt}))"
    )
    whole = f"({aw}*{ah} + {bw}*{bh} - {inter})"
    return f"(case when {whole} = 0 then 0.0 else {inter} / {whole} end)"


def _box_iou(a: str, b: str) -> str:
    return _iou(*[f"{x}.{c}" for x in (a, b) for c in "ltwh"])


def _clock() -> str:
    seconds = f"{START_S} + frame_no * {STEP_S} + (frame_no // {OUTAGE_EVERY}) * {OUTAGE_S}"
    return f"make_timestamp(({seconds}) * 1000000)"


CTES: dict[str, str] = {}
for _name in DIMS:
    CTES[_name] = f"select * from (values {values(_name)}) as v({', '.join(columns(_name))})"

CTES |= {
    "ev": """
        select *, event_id % 15 as cam_no, event_id // 15 as seq from events""",
    "num": f"""
        select *, b // 8 as grp, b % 8 as step, b + b // 12 as frame_no,
               {_list(CAMS)}[cam_no + 1] as cam
        from (select *, seq // 3 as b, seq % 3 as det_no from ev)""",
    "det_of": f"""
        select frame_no * 15 + cam_no as frame_id, cam, frame_no, {_clock()} as frame_ts,
               cast(det_no as int) as det_no, cast(tag_no as int) as tag_id,
               {_list(TAGS)}[tag_no + 1] as tag,
               ((event_id * 73 + user_id * 19) % 128) / 128.0::double as prob,
               ((bd*37 + grp*11 + cam_no*5) % 40) / 64.0::double
                 + (step + 8*(det_no - bd)) / 512.0::double as l,
               ((bd*23 + grp*7 + cam_no*3 + jump*20) % 40) / 64.0::double as t,
               (8 + (grp + bd) % 8) / 64.0::double as w,
               (8 + (grp*3 + bd) % 8) / 64.0::double as h
        from (select *,
                case when det_no = 2 and grp % 3 = 0 then 0 else det_no end as bd,
                case when (b*7 + cam_no + det_no) % 11 = 0 then 1 else 0 end as jump,
                (cam_no*5 + (det_no % 2)*3 + grp) % 10 as tag_no
              from num)""",
    "det": "select *, l + w / 2 as cx, t + h / 2 as cy from det_of",
    "frm": f"""
        select frame_no * 15 + cam_no as frame_id, cam, frame_no, {_clock()} as frame_ts, frame_no % 5 = 0 as is_grey, cam = 'cam14' as is_file,
               '/drop/' || cam || '/' || frame_no || '.jpg' as source,
               md5(cam || '-' || ((frame_no % 4) // 2)) as hash
        from (select distinct cam, cam_no, frame_no from num
              union
              select distinct cam, cam_no, frame_no + 1 from num where b % 12 = 11)""",
    "cams": """
        select cam, cam_no, interval_s, vehicle_check, road,
               case when road = 'all' then 'all' when road <> '' then 'line' end as road_mode,
               string_split(publish, ',') as publish
        from cameras_t""",
    "road_pts": """
        select cam, i, cast(trim(split_part(p, ':', 1)) as double) as x,
               cast(trim(split_part(p, ':', 2)) as double) as y
        from (select cam, unnest(string_split(road, ',')) as p,
                     generate_subscripts(string_split(road, ','), 1) as i
              from cams where road_mode = 'line')""",
    "road_seg": """
        select cam, i, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1,
               first_value(x) over w as fx, first_value(y) over w as fy,
               last_value(x) over (partition by cam order by i
                 rows between unbounded preceding and unbounded following) as lx,
               last_value(y) over (partition by cam order by i
                 rows between unbounded preceding and unbounded following) as ly
        from road_pts window w as (partition by cam order by i)""",
    "road_hit": """
        select d.frame_id, d.det_no,
               case when d.cx <= s.fx then s.fy when d.cx >= s.lx then s.ly
                    else s.y0 + (d.cx - s.x0) / (s.x1 - s.x0) * (s.y1 - s.y0) end as road_y
        from det d join road_seg s on s.cam = d.cam
        where (d.cx <= s.fx and s.i = 1) or (d.cx > s.fx and d.cx >= s.lx and s.i = 1)
           or (d.cx > s.fx and d.cx < s.lx and s.x0 <= d.cx and d.cx <= s.x1)
        qualify row_number() over (partition by d.frame_id, d.det_no order by s.i) = 1""",
    "roaded": """
        select d.* exclude (tag), d.tag as raw_tag, r.road_y,
               case when (c.road_mode = 'all' or d.cy < r.road_y)
                         and d.tag in ('person', 'vehicle', 'dog')
                    then d.tag || '_road' else d.tag end as tag,
               case when d.cy < r.road_y and d.tag = 'vehicle' then 'road' end as ignore
        from det d left join cams c on c.cam = d.cam
        left join road_hit r on r.frame_id = d.frame_id and r.det_no = d.det_no""",
    "regioned": """
        select * exclude (tag, ignore),
          case when cam = 'garage-l' and t + h < 0.24 and tag in ('vehicle', 'person')
               then tag || '_road' else tag end as tag,
          case when cam = 'garage-l' and t + h < 0.24 and tag in ('vehicle', 'person')
               then 'road'
               when cam = 'front entry' and tag = 'package' and cx < 0.178125
               then 'in grass' else ignore end as ignore
        from roaded""",
    "zoned": f"""
        select d.frame_id, d.det_no,
          (list(coalesce(e.comment, 'static') order by e.ord) filter (where e.tag = '*'))[1]
            as any_hit,
          (list(coalesce(e.comment, 'static iou ' || cast({_box_iou('e', 'd')} as varchar))
             order by e.ord) filter (where e.tag <> '*'))[1] as tag_hit
        from regioned d join excludes_t e on e.cam = d.cam and e.tag in ('*', d.tag)
        where {_box_iou('e', 'd')} > 0.5
        group by all""",
    "prep": """
        select d.* exclude (ignore),
               coalesce(d.ignore, z.tag_hit, z.any_hit) as ignore
        from regioned d left join zoned z on z.frame_id = d.frame_id and z.det_no = d.det_no""",
    "valid": "select * from prep where ignore is null",
    "st": f"""
        select {_list(ENTITIES)}[event_id % 6 + 1] as entity,
               make_timestamp(({START_S}000 + event_id * 667) * 1000) as ts,
               case {_list(ENTITIES)}[event_id % 6 + 1]
                 when 'presence' then case when user_id % 2 = 0 then 'home' else 'away' end
                 when 'dog_status' then case when user_id % 2 = 0 then 'inside' else 'outside' end
                 else case when user_id % 2 = 0 then 'on' else 'off' end end as state
        from events""",
}
_asof = "frm f"
for _i, _e in enumerate(ENTITIES):
    _asof += (
        f" asof left join (select * from st where entity = '{_e}') s{_i}"
        f" on f.frame_ts >= s{_i}.ts"
    )
# Filled below: what passes hysteresis, its tracks, and the detections linked to them.
CTES |= dict.fromkeys(["vkept", "kfold", "ktrk", "ktout", "lnk"], "")
CTES |= {
    "fst": f"""
        select *, case when night_mode = 'on' then 'night' when presence = 'home' then 'home'
                       else 'away' end as mode
        from (select f.frame_id, f.cam, f.frame_no, f.frame_ts,
                     {', '.join(f's{i}.state as {e}' for i, e in enumerate(ENTITIES))},
                     {' or '.join(f's{i}.state is null' for i in range(len(ENTITIES)))}
                       as missing_state
              from {_asof})""",
    "ctx": """
        select frame_id,
          bool_or(tag = 'person') as has_person, bool_or(tag = 'dog') as has_dog,
          bool_or(tag = 'person_road') as has_person_road,
          bool_or(tag = 'dog_road') as has_dog_road,
          bool_or(tag = 'package') as has_package, bool_or(tag = 'vehicle') as has_vehicle,
          count(*) filter (where tag = 'vehicle' and age < 3) as visible_vehicles
        from lnk group by frame_id""",
    "pub": """
        select f.cam, f.frame_id, f.frame_no, f.frame_ts, c.tag
        from frm f join (select cam, unnest(publish) as tag from cams) c on c.cam = f.cam
        where c.tag <> ''""",
    "counts": """
        select p.*, count(d.frame_id) as count
        from pub p left join lnk d on d.frame_id = p.frame_id and d.tag = p.tag
          and (d.tag <> 'package' or d.age > 0)
        group by all""",
    "shows": """
        select f.cam, f.frame_id, f.frame_no, f.frame_ts,
               cast(coalesce(sum(count), 0) as bigint) as show_count,
               coalesce(sum(count), 0) > 0 as "show"
        from frm f left join counts c on c.frame_id = f.frame_id
        group by f.cam, f.frame_id, f.frame_no, f.frame_ts""",
}


def _scored(name: str, source: str, context: str) -> str:
    """The alert rules over `source` (needs iou) with frame facts from `context`."""
    return f"""
        select frame_id, det_no, tag, cam, prob, scored, iou, age,
          cast(case when scored then (case when o3 then 1 when o2 then 1 when o1 then 1
                 else p end) else -4 end as int) as priority,
          case when scored then (case when o3 then tag || ' on ' || cam
                 when o2 then 'dog in garage rule' when o1 then 'fruit robber' else why end) end
            as priority_type
        from (select *,
            cam = 'peach tree' and mode = 'night' and p < 1 as o1,
            tag = 'dog' and cam = 'garage' and prob > 0.9 and not has_person
              and coalesce(dog_status = 'inside', false) as o2,
            tag in ('fox', 'coyote') and cam = 'deck'
              and (case when cam = 'peach tree' and mode = 'night' and p < 1 then 1 else p end) < 1
              as o3
          from (select r.*,
              case when tag = 'person_road' then case when watch then 0 else -4 end
                when tag = 'dog_road' then case when has_person_road then -3 else 1 end
                when tag = 'vehicle' and cam = 'front entry' then -3
                when tag = 'cat' and cam = 'garage' then -2
                when tag = 'person' and cam = 'garage' then -3
                when person_off then -4
                when tag = 'deer' and has_person then -1
                when tag = 'vehicle' and not vehicle_on then -4
                else coalesce(m.priority, b.priority, 0) end as p,
              case when tag = 'person_road' then null
                when tag = 'dog_road' then case when has_person_road then 'person walking dog'
                  else 'dog without person' end
                when tag = 'vehicle' and cam = 'front entry' then 'vehicle rule'
                when tag = 'cat' and cam = 'garage' then 'cat in garage rule'
                when tag = 'person' and cam = 'garage' then 'person in garage rule'
                when person_off then 'person detection off'
                when tag = 'deer' and has_person then 'deer and person not possible'
                when tag = 'vehicle' and not vehicle_on then 'vehicle detection off'
                when m.priority is not null then 'priority-' || r.mode
                when b.priority is not null then 'class ' || tag
                else 'default' end as why
            from (select q.*,
                tag = 'person' and has_person and not coalesce(
                  (select x.watch from {name}_in x where x.frame_id = q.frame_id
                     and x.det_no < q.det_no and x.scored and x.tag = 'person_road'
                   order by x.det_no desc limit 1),
                  coalesce(person_detector = 'on', false)) as person_off
              from {name}_in q) r
            left join (select mode as m_mode, tag as m_tag, priority from priorities_t) m
              on m.m_mode = r.mode and m.m_tag = r.tag
            left join (select mode as b_mode, tag as b_tag, priority from priorities_t) b
              on b.b_mode is null and b.b_tag = r.tag))"""


def _scored_in(source: str, context: str) -> str:
    return f"""
        select d.*, c.* exclude (frame_id), s.mode, s.person_detector, s.dog_status,
          d.iou is null and d.ignore is null as scored,
          s.mode = 'night' and extract(hour from d.frame_ts) < 6 as watch,
          c.has_vehicle and d.cam <> 'mailbox' and coalesce(s.vehicle_detector = 'on', false)
            as vehicle_on
        from {source} d join {context} c on c.frame_id = d.frame_id
        left join fst s on s.frame_id = d.frame_id"""


CTES |= {
    "sc_in": _scored_in("lnk", "ctx"),
    "sc": _scored("sc", "lnk", "ctx"),
    "allnew": "select *, null::double as iou, 0 as age from prep",
    "ctx_all": """
        select frame_id,
          bool_or(tag = 'person' and ignore is null) as has_person,
          bool_or(tag = 'dog') as has_dog,
          bool_or(tag = 'person_road') as has_person_road,
          bool_or(tag = 'vehicle' and ignore is null) as has_vehicle
        from prep group by frame_id""",
    "scn_in": _scored_in("allnew", "ctx_all"),
    "scn": _scored("scn", "allnew", "ctx_all"),
    "fpri": """
        select s.frame_id, cast(case when bool_or(c.has_package and c.has_dog
                   and coalesce(f.dog_status = 'inside', false)) then 1
                 else coalesce(max(s.priority) filter (where scored),
                               arg_max(s.priority, s.det_no), 0) end as int) as priority
        from sc s join ctx c on c.frame_id = s.frame_id
        left join fst f on f.frame_id = s.frame_id group by s.frame_id""",
    "snd": """
        select s.frame_id, coalesce(arg_max(t.sound, s.det_no)
                 filter (where s.scored and t.sound is not null), 'pushover') as sound
        from sc s left join sounds_t t on t.tag = s.tag group by s.frame_id""",
    "sets": """
        select f.frame_id, f.cam, f.frame_no, f.frame_ts,
          coalesce(list_sort(list(distinct d.tag) filter (where d.tag is not null)), []) as tags,
          coalesce(list_sort(list(distinct d.tag) filter (where d.is_new)), []) as new_tags
        from frm f left join lnk d on d.frame_id = f.frame_id group by all""",
    "warm": """
        select frame_id, cam,
               count(*) over (partition by cam order by frame_ts, frame_no) as cam_age
        from frm""",
    "gate": """
        select w.frame_id from warm w
        where cam_age > 2 and w.frame_id in (select frame_id from lnk where is_new)""",
    "pri_in": """
        select s.*, case when w.cam_age > 2 then p.priority end as scored
        from sets s left join fpri p on p.frame_id = s.frame_id
        join warm w on w.frame_id = s.frame_id""",
    "pri": """
        select *, cast(coalesce(last_value(case when len(new_tags) > 0 then coalesce(scored, -4)
                     when len(tags) = 0 then -4 end ignore nulls) over (
                     partition by cam order by frame_ts, frame_no
                     rows between unbounded preceding and current row), -4) as int) as priority
        from pri_in""",
    "ages": """
        select f.frame_id, f.cam, coalesce(min(d.age), 1000000) as min_age
        from frm f left join lnk d on d.frame_id = f.frame_id group by all""",
    "save": """
        select f.frame_id, f.cam, f.frame_ts, p.priority, p.tags, a.min_age
        from frm f join pri p on p.frame_id = f.frame_id join ages a on a.frame_id = f.frame_id
        where p.priority > -3 and not f.is_file and a.min_age < 2""",
    "raw": """
        select frame_id, ['color', 'grey', 'vehicle'][(det_no + i) % 3 + 1] as model,
               cast(det_no * 5 + i as int) as box_no, tag_id as class_id,
               prob - i / 256.0::double as conf, l + i / 64.0::double as x1, t as y1,
               l + i / 64.0::double + w as x2, t + h as y2
        from det, (select unnest(range(5)) as i)""",
    "known": """
        select substr(upper(md5('K' || c_custkey)), 1, 8) as plate, cast(c_custkey as int) as ord,
               case when c_custkey % 3 <> 0 then c_name end as owner,
               case when c_custkey % 4 <> 0 then lower(c_mktsegment) end as color,
               case when c_custkey % 5 <> 0 then 'Make' || c_nationkey end as make,
               case when c_custkey % 2 <> 0 then 'M' || (c_custkey % 10) end as model,
               c_custkey % 7 <> 0 as announce
        from customer""",
    "rds": """
        select o_orderkey as read_id, o_custkey, o_orderdate as ts,
          case o_orderkey % 5 when 0 then plate
            when 1 then substr(plate, 1, 3) || 'Z' || substr(plate, 4)
            when 2 then substr(plate, 1, 5) || substr(plate, 7)
            when 3 then 'Q' || substr(plate, 2, 3) || 'W' || substr(plate, 6)
            else substr(upper(md5('R' || o_orderkey)), 1, 8) end as plate
        from orders join known on ord = o_custkey""",
    "keys_r": """
        select distinct plate, substr(plate, 1, i - 1) || substr(plate, i + 1) as k1
        from (select distinct plate from rds), (select unnest(range(1, 11)) as i)""",
    "keys_k": """
        select distinct plate, substr(plate, 1, i - 1) || substr(plate, i + 1) as k1
        from known, (select unnest(range(1, 11)) as i)""",
    "keys_r2": """
        select distinct plate, substr(k1, 1, i - 1) || substr(k1, i + 1) as k
        from keys_r, (select unnest(range(1, 11)) as i)""",
    "keys_k2": """
        select distinct plate, substr(k1, 1, i - 1) || substr(k1, i + 1) as k
        from keys_k, (select unnest(range(1, 11)) as i)""",
    "best": """
        select r.plate, arg_min({'p': n.plate, 'd': r.d}, r.d * 1000000000 + n.ord) as b
        from (select distinct a.plate, b.plate as kp, levenshtein(a.plate, b.plate) as d
              from keys_r2 a join keys_k2 b on a.k = b.k
              where levenshtein(a.plate, b.plate) <= 2) r
        join known n on n.plate = r.kp group by r.plate""",
    "matched": """
        select r.*, b.b.p as known_plate, cast(b.b.d as int) as distance
        from rds r left join best b on b.plate = r.plate""",
    "resp": """
        select read_id // 3 as response_id, (read_id // 3) % 13 <> 0 as success,
               count(*) as count,
               list(plate order by read_id) filter (where read_id % 11 <> 0) as plates
        from rds group by all""",
    "alpr": """
        select response_id, case when success then coalesce(plates, []) else [] end as plates,
               count from resp""",
    "told": """
        select a.response_id, a.pos, a.plate, k.announce, b.b.p as known_plate,
          case when k.plate is not null then
            coalesce(k.owner || '''s ', '') || coalesce(k.color || ' ', '')
            || coalesce(k.make || ' ' || coalesce(k.model, ''), 'vehicle') end as own
        from (select response_id, unnest(plates) as plate,
                     generate_subscripts(plates, 1) - 1 as pos from alpr) a
        left join best b on b.plate = a.plate left join known k on k.plate = b.b.p""",
    "phr": """
        select x.response_id, cast(x.pos as int) as pos, x.plate,
          coalesce((select case when min(pos) filter (where own is null)
                             < coalesce(min(pos) filter (where own is not null), 1000)
                           then 'Vehicle' || coalesce(' and ' || string_agg(own, ' and ' order by pos), '')
                           else string_agg(own, ' and ' order by pos) end
                    from told y where y.response_id = x.response_id and y.pos <= x.pos
                      and coalesce(y.announce, true)), 'Vehicle') as phrase
        from told x where coalesce(x.announce, true)""",
    "flg": f"""
        select event_id, make_timestamp(({START_S}000 + event_id * 667 - 600000) * 1000) as ts,
               case when user_id % 9 = 0 then 'attic' else replace(cam, ' ', '_') end as cam_key,
               case when user_id % 2 = 0 then 'flag_vehicle' else 'flag_detection' end as flag_type
        from num where event_type not in ('error', 'signup')""",
    "flc": """
        select f.event_id, f.ts, c.cam, f.flag_type,
          case f.flag_type when 'flag_vehicle' then 'vehicle' else 'detection' end as model,
          case f.flag_type when 'flag_vehicle' then 'vehicle,package'
               else array_to_string(list_sort(list_filter(c.publish, lambda x: x <> '')), ',') end
            as tags
        from flg f left join cams c on replace(c.cam, ' ', '_') = f.cam_key""",
    "flf": """
        select f.*, r.frame_id,
          case when f.cam is null then 'unknown camera' when r.frame_id is null then 'no image'
               else 'ok' end as status
        from flc f asof left join frm r on f.cam = r.cam and f.ts >= r.frame_ts""",
    "rf": """
        select event_id || '.jpg' as file, model, cam, tags, e.value >= 5 as here
        from flf join events e using (event_id) where status = 'ok'""",
    "proj": """
        select project_id, unnest(string_split(classes, ',')) as tag from projects_t""",
    "rt": """
        select f.file, f.cam, f.model, f.tags,
          case when not here then '404' when p.project_id is null then '400' else 'ready' end
            as status,
          case when here then p.project_id end as project_id
        from rf f left join (select distinct t.tags, p.project_id
             from (select tags, unnest(string_split(tags, ',')) as tag
                   from (select distinct tags from rf)) t
             join proj p on p.tag = t.tag) p on here and p.tags = f.tags""",
    "grid": f"""
        select frame_id, cast(event_id % 13 as int) as row, cast(event_id % 11 as int) as col,
               cast((event_id + det_no) % 5 as int) as anchor, det_no,
               {', '.join(f"((event_id * {7 + 6 * k} + user_id * {3 + 2 * k}) % 33 - 16) / 8.0::double as v{k}" for k in range(9))}
        from (select *, frame_no * 15 + cam_no as frame_id from num)""",
    "anch": """
        select * from (values (0, 0.573::double, 0.677::double), (1, 1.87, 2.06),
          (2, 3.34, 5.47), (3, 7.88, 3.53), (4, 9.77, 9.17)) as a(anchor, aw, ah)""",
}


def _flat(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (
        f"{a}frame_id, {a}cam, {a}det_no, {a}tag, {a}l as left, {a}t as top, {a}w as width,"
        f" {a}h as height"
    )


def _nms(min_mode: bool) -> str:
    """Greedy suppression as a fold over the sorted boxes of a class."""
    inter = (
        "greatest(0.0, least(k.x2, b.x2) - greatest(k.x1, b.x1))"
        " * greatest(0.0, least(k.y2, b.y2) - greatest(k.y1, b.y1))"
    )
    area = lambda r: f"(({r}.x2 - {r}.x1) * ({r}.y2 - {r}.y1))"
    whole = (
        f"least({area('k')}, {area('b')})" if min_mode else f"({area('k')} + {area('b')} - {inter})"
    )
    return f"""
        select frame_id, model, cast(row_number() over (partition by frame_id, model
                 order by class_id, pos) - 1 as int) as det_no, k.box_no as box_no,
               class_id as tag_id, k.conf as conf, k.x1 as x1, k.y1 as y1, k.x2 as x2, k.y2 as y2
        from (select frame_id, model, class_id, unnest(kept) as k,
                     generate_subscripts(kept, 1) as pos
              from (select frame_id, model, class_id, list_reduce(boxes,
                      lambda acc, b: case when len(list_filter(acc, lambda k:
                          not ({inter} <= 0.6 * {whole}))) > 0 then acc
                        else list_append(acc, b) end, boxes[1:0]) as kept
                    from (select frame_id, model, class_id,
                            list({{'box_no': box_no, 'conf': conf, 'x1': x1, 'y1': y1,
                                   'x2': x2, 'y2': y2}} order by conf desc, box_no) as boxes
                          from raw where conf > 0.4 group by frame_id, model, class_id)))"""


_BOXES = """frame_id, model, det_no, box_no, tag_id, round(conf, 6) as prob,
    round(round(x1, 8), 6) as left, round(round(y1, 8), 6) as top,
    round(round(x2 - x1, 8), 6) as width, round(round(y2 - y1, 8), 6) as height"""

_TRACK_TYPE = (
    "struct(f bigint, d int, st bigint, l double, t double, w double, h double, last bigint,"
    " age int, fa int, fl double, ft double, fw double, fh double)[]"
)
_OUT_TYPE = "struct(f bigint, d int, tf bigint, td int, st bigint, iou double, age int)[]"


def _tracker(source: str) -> str:
    """The tracker as a fold over the detections of each camera and tag."""
    iou = _iou("k.l", "k.t", "k.w", "k.h", "x.l", "x.t", "x.w", "x.h")
    last = iou.replace("k.", "hit[-1].")
    gone = "x.prev > k.last + least(60 + k.age * x.iv, 3600) * 1000000"
    same = lambda new, old: f"case when k.f = x.f then {new} else {old} end"
    moved = (
        "{'f': k.f, 'd': k.d, 'st': k.st, 'l': x.l, 't': x.t, 'w': x.w, 'h': x.h,"
        " 'last': x.now, 'age': cast(k.age + 1 as int),"
        f" 'fa': cast({same('k.age + 1', 'k.fa')} as int), 'fl': {same('x.l', 'k.fl')},"
        f" 'ft': {same('x.t', 'k.ft')}, 'fw': {same('x.w', 'k.fw')},"
        f" 'fh': {same('x.h', 'k.fh')}}}"
    )
    born = (
        "{'f': x.f, 'd': x.d, 'st': x.now, 'l': x.l, 't': x.t, 'w': x.w, 'h': x.h,"
        " 'last': x.now, 'age': 0::int, 'fa': 0::int, 'fl': x.l, 'ft': x.t, 'fw': x.w,"
        " 'fh': x.h}"
    )
    return f"""
        select cam, tag, list_reduce(dets, lambda s, x:
          list_transform([list_filter(s.tr, lambda k: not ({gone}))], lambda live:
            list_transform([list_filter(live, lambda k: {iou} > 0.5)], lambda hit: {{
              'tr': case when len(hit) = 0 then list_append(live, {born})
                    else list_transform(live, lambda k:
                      case when {iou} > 0.5 then {moved} else k end) end,
              'gone': list_concat(s.gone, list_filter(s.tr, lambda k: {gone})),
              'out': case when len(hit) = 0 then s.out else list_append(s.out,
                 {{'f': x.f, 'd': x.d, 'tf': hit[-1].f, 'td': hit[-1].d, 'st': hit[-1].st,
                   'iou': {last}, 'age': cast(hit[-1].age + 1 as int)}}) end
            }})[1])[1],
          {{'tr': cast([] as {_TRACK_TYPE}), 'gone': cast([] as {_TRACK_TYPE}),
            'out': cast([] as {_OUT_TYPE})}}) as s
        from (select v.cam, v.tag, list({{'f': v.frame_id, 'd': v.det_no,
                'now': epoch_us(v.frame_ts), 'prev': coalesce(epoch_us(p.prev_ts), -1),
                'l': v.l, 't': v.t, 'w': v.w, 'h': v.h, 'iv': c.interval_s}}
                order by v.frame_ts, v.frame_no, v.det_no) as dets
              from {source} v join cams c on c.cam = v.cam
              join (select frame_id, lag(frame_ts) over (partition by cam
                      order by frame_ts, frame_no) as prev_ts from frm) p
                on p.frame_id = v.frame_id
              group by v.cam, v.tag)"""


def _suppress(grid: str, number: str, digits: int = 18) -> str:
    """Suppression that zeroes one class at a time, as 20 rounds over a frame's candidates."""
    iou = _iou("a[1]", "a[2]", "a[3]", "a[4]", "c[1]", "c[2]", "c[3]", "c[4]")
    tops = "list_transform(s.p, lambda q: list_max(q))"
    p = "[" + ", ".join(f"e{k} / ez * ob" for k in range(4)) + "]"
    if digits < 18:
        p = f"list_transform({p}, lambda v: round(v, {digits}))"
    return f"""
        select frame_id, unnest(list_reduce(range(20), lambda s, r:
          list_transform([list_max({tops})], lambda top:
            case when top < 0.1 or len(s.out) >= len(s.p) then s else
              list_transform([list_position({tops}, top)], lambda i:
                list_transform([list_position(s.p[i], top)], lambda kind: {{
                  'p': list_transform(s.p, lambda q, j: list_transform([s.b[i]], lambda a:
                         list_transform([s.b[j]], lambda c:
                           case when j = i or {iou} > 0.45
                             then list_transform(q, lambda v, n: case when n = kind then 0.0::double
                                                                 else v end)
                             else q end)[1])[1]),
                  'b': s.b,
                  'out': list_append(s.out, {{'i': i::bigint, 'kind': kind::bigint, 'v': top,
                                              'n': len(s.out)::bigint}}) }})[1])[1] end)[1],
          {{'p': p, 'b': b,
            'out': cast([] as struct(i bigint, kind bigint, v double, n bigint)[])}}).out) as o,
          nos, b
        from (select frame_id, list(no order by top desc, no) as nos,
                     list(p order by top desc, no) as p, list(b order by top desc, no) as b
              from (select frame_id, {number} as no,
                      [bx - bw / 2, bym - bh / 2, bw, bh] as b,
                      {p} as p, list_max({p}) as top
                    from (select *, e0 + e1 + e2 + e3 as ez from {grid}))
              where top > 0.1 group by frame_id)"""


def _decode(grid: str) -> str:
    return f"""
        select g.*, (sx + g.col) / 13 as bx, (sy + g.row) / 13 as bym, ew * aw / 13 as bw,
               eh * ah / 13 as bh, exp(v5 - m) as e0, exp(v6 - m) as e1, exp(v7 - m) as e2,
               exp(v8 - m) as e3
        from (select *, 1 / (1 + exp(-v0)) as sx, 1 / (1 + exp(-v1)) as sy,
                1 / (1 + exp(-v4)) as ob, exp(v2) as ew, exp(v3) as eh,
                greatest(v5, v6, v7, v8) as m from {grid}) g
        join anch a on a.anchor = g.anchor"""


CTES["gdec"] = _decode("grid")
CTES["grid2"] = """
        select * exclude (row, col), cast(frame_id % 2 as int) as row, det_no % 2 as col
        from grid"""
CTES["gdec2"] = _decode("grid2")


def _picked(found: str) -> str:
    return f"""
        select frame_id, cast(o.n as int) as det_no, cast(nos[o.i] as int) as box_no,
               cast(o.kind - 1 as int) as tag_id, round(o.v, 8) as prob,
               round(b[o.i][1], 8) as left, round(b[o.i][2], 8) as top,
               round(b[o.i][3], 8) as width, round(b[o.i][4], 8) as height from {found}"""


CTES["supp"] = _suppress("gdec2", "row * 100 + col * 10 + anchor")
CTES["grid3"] = """
        select * exclude (frame_id, row, col), frame_id // 40 as frame_id,
          cast(frame_id % 40 // 4 as int) as row, cast(frame_id % 4 * 3 + det_no as int) as col
        from grid"""
CTES["gdec3"] = _decode("grid3")
CTES["supp3"] = _suppress("gdec3", "row * 1000 + col * 10 + anchor", 9)


def _tracks(fold: str) -> str:
    return f"select cam, tag, unnest(list_concat(s.tr, s.gone), recursive := true) from {fold}"


def _followed(fold: str) -> str:
    return f"select cam, tag, unnest(s.out, recursive := true) from {fold}"


def _departed(tracks: str) -> str:
    return f"""
        select t.*, f.frame_ts as departed_ts, f.frame_id as dfid
        from (select k.cam, k.tag, k.f, k.d, make_timestamp(k.st) as start_ts,
                make_timestamp(k.last) as last_ts, k.age,
                make_timestamp(k.last + least(60 + k.age * c.interval_s, 3600)::bigint * 1000000)
                  as deadline
              from {tracks} k join cams c on c.cam = k.cam) t
        asof left join frm f on t.cam = f.cam and t.deadline < f.frame_ts"""


def _told(departures: str) -> str:
    """Departures worth telling, with their text."""
    return f"""
        select *, tag || ' departed from ' || cam || ' after being seen ' || age
          || ' times over the past ' || case
            when s < 3600 then case when s // 60 = 1 then 'minute' else s // 60 || ' minutes' end
            when s < 86400 then case when s // 3600 = 1 then 'an hour'
                                     else s // 3600 || ' hours' end
            else case when s // 86400 = 1 then 'a day' else s // 86400 || ' days' end end as msg
        from (select *, (epoch_us(departed_ts) - epoch_us(start_ts)) // 1000000 as s
              from {departures})
        where epoch_us(departed_ts) - epoch_us(start_ts) > 120000000 and age > 4"""


CTES["tfold"] = _tracker("valid")
CTES["trk"] = _tracks("tfold")
CTES["tout"] = _followed("tfold")
CTES["tdep"] = _departed("trk")
CTES["kfold"] = _tracker("vkept")
CTES["ktrk"] = _tracks("kfold")
CTES["ktout"] = _followed("kfold")
CTES["kdep"] = _departed("ktrk")
CTES["lnk"] = """
        select v.* exclude (l, t, w, h), k.fl as l, k.ft as t, k.fw as w, k.fh as h,
               null::double as iou, k.fa as age, true as is_new
        from ktrk k join vkept v on v.frame_id = k.f and v.det_no = k.d
        union all by name
        select v.*, o.iou, o.age, false as is_new
        from ktout o join vkept v on v.frame_id = o.f and v.det_no = o.d"""
# What leaves a frame; `iou` stands for a priority that the track already has.
CTES["dep"] = f"""
        select x.dfid as frame_id, x.cam, x.departed_ts as frame_ts, x.tag, x.age, x.msg, v.prob,
          null::varchar as ignore, case when g.frame_id is not null then 0.0::double end as iou,
          case when g.frame_id is not null then p.priority end as prior,
          cast(row_number() over (partition by x.dfid
            order by n.fts, n.fno, n.fdet, x.start_ts, v.frame_no, v.det_no) - 1 as int) as det_no
        from ({_told("kdep")}) x
        join vkept v on v.frame_id = x.f and v.det_no = x.d
        join sc p on p.frame_id = x.f and p.det_no = x.d
        left join gate g on g.frame_id = x.f
        join (select cam, tag, arg_min(frame_ts, k) as fts, arg_min(frame_no, k) as fno,
                arg_min(det_no, k) as fdet
              from (select *, {{'a': frame_ts, 'b': frame_no, 'c': det_no}} as k from lnk)
              group by cam, tag) n
          on n.cam = x.cam and n.tag = x.tag
        where x.dfid is not null"""
CTES["dctx"] = """
        select frame_id, bool_or(tag = 'person') as has_person, bool_or(tag = 'dog') as has_dog,
          bool_or(tag = 'person_road') as has_person_road,
          bool_or(tag = 'vehicle') as has_vehicle
        from dep group by frame_id"""
CTES["dsc_in"] = _scored_in("dep", "dctx")
CTES["dsc"] = _scored("dsc", "dep", "dctx")
CTES["dal"] = """
        select d.cam, d.frame_id, d.frame_ts, string_agg(d.msg, ', ' order by d.det_no) as message,
          list_sort(list(distinct d.tag)) as tags,
          cast(coalesce(max(s.priority) filter (where s.scored),
                        arg_max(coalesce(d.prior, s.priority), d.det_no), 0) as int) as priority,
          case when bool_or(s.scored) then coalesce(
            (select max(sound) from sounds_t where tag = 'departed'), 'pushover')
            else 'pushover' end as sound
        from dep d join dsc s on s.frame_id = d.frame_id and s.det_no = d.det_no
        group by d.cam, d.frame_id, d.frame_ts"""
CTES["dalp"] = """
        select d.*, d.priority >= -3 and coalesce(f.vacation_mode = 'off', false) as push
        from dal d left join fst f on f.frame_id = d.frame_id"""
CTES["told2"] = """
        select x.response_id as frame_id, f.cam, x.pos, x.plate, x.phrase
        from phr x join frm f on f.frame_id = x.response_id
        join ctx c on c.frame_id = x.response_id join alpr a on a.response_id = x.response_id
        join gate g on g.frame_id = x.response_id
        where c.visible_vehicles > 0 and a.count >= 1"""
CTES["al"] = """
        select s.cam, s.frame_id, s.frame_ts, s.tags, f.mode,
          array_to_string(s.tags, ',') || ' ' || case s.cam
            when 'driveway' then 'in driveway' when 'garage' then 'in garage'
            when 'shed' then 'in front of garage' when 'garage-r' then 'in front of left garage'
            when 'garage-l' then 'in front of right garage' else 'near ' || s.cam end
            || coalesce((select string_agg(chr(10) || t.phrase || ' ' || t.plate, '' order by t.pos)
                         from told2 t where t.frame_id = s.frame_id), '') as message,
          p.priority, n.sound,
          p.priority >= -3 and coalesce(f.vacation_mode = 'off', false) as push
        from sets s join gate g on g.frame_id = s.frame_id
        join fpri p on p.frame_id = s.frame_id join snd n on n.frame_id = s.frame_id
        left join fst f on f.frame_id = s.frame_id"""
CTES["nms"] = _nms(False)
CTES["nms_min"] = _nms(True)

ORACLE: dict[str, str] = {
    "s2_drop_repeat_frames": """
        select frame_id, cam, frame_no, frame_ts, hash from frm
        qualify hash is distinct from
          lag(hash) over (partition by cam order by frame_ts, frame_no)""",
    "s3_sidecars": """
        select f.source, strftime(f.frame_ts, '%Y-%m-%d %H:%M:%S') as time, d.det_no as pos,
               d.tag, d.tag_id, d.prob, d.ignore, d.l as left, d.t as top
        from prep d join frm f on f.frame_id = d.frame_id""",
    "s4_sightings_today": """
        select frame_id, cam, strftime(frame_ts, '%Y%m%d') as dt from frm
        where strftime(frame_ts, '%Y%m%d') = (select max(strftime(frame_ts, '%Y%m%d')) from frm)""",
    "s7_latest_by_tag": """
        select tag, arg_max(frame_id, {'a': frame_ts, 'b': frame_id}) as frame_id,
               max(frame_ts) as frame_ts
        from (select frame_id, frame_ts, unnest(tags) as tag from al
              union all select frame_id, frame_ts, unnest(tags) from dal) group by tag""",
    "s8_file_camera": """
        select cam, count(*) as savable from frm where not is_file group by cam""",
    "f1_route_models": """
        select n.frame_id, f.cam, cast(row_number() over (partition by n.frame_id
                 order by n.model = 'vehicle', n.det_no) - 1 as int) as det_no,
               n.model, n.tag_id, n.box_no, round(n.conf, 6) as prob
        from nms n join frm f on f.frame_id = n.frame_id join cams c on c.cam = f.cam
        where n.model = (case when f.is_grey then 'grey' else 'color' end)
           or (n.model = 'vehicle' and c.vehicle_check)""",
    "f2_center": "select frame_id, det_no, cx, cy from det",
    "f3_hysteresis": f"""
        with thr as (select p.*, coalesce(t.min_prob, {THRESHOLD}) as thr
                     from prep p left join thresholds_t t on t.tag = p.raw_tag),
        fr as (select *, row_number() over (partition by cam order by frame_ts, frame_no) as n
               from frm),
        tags as (select distinct cam, tag from thr where tag = raw_tag and ignore is null),
        grid as (select f.cam, t.tag, f.n, f.frame_id,
                   coalesce(bool_or(d.prob > d.thr), false) as strong,
                   coalesce(bool_or(d.prob > 0.4), false) as weak
                 from fr f join tags t on t.cam = f.cam
                 left join thr d on d.frame_id = f.frame_id and d.tag = t.tag
                   and d.raw_tag = d.tag and d.ignore is null
                 group by all),
        run as (select *, sum(case when strong or weak then 0 else 1 end)
                  over (partition by cam, tag order by n) as run from grid),
        pres as (select *, bool_or(strong) over (partition by cam, tag, run order by n
                   rows between unbounded preceding and current row) as present from run)
        select d.frame_id, d.cam, d.det_no, d.raw_tag, d.tag, d.prob, d.ignore
        from thr d join fr f on f.frame_id = d.frame_id
        left join pres p on p.cam = d.cam and p.tag = d.raw_tag and p.n = f.n - 1
        where d.prob > d.thr or (coalesce(p.present, false) and d.prob > 0.4)""",
    "f4_region_rules": f"""
        select {_flat()}, raw_tag, ignore from (
          select * exclude (tag), tag as raw_tag,
            case when cam = 'garage-l' and t + h < 0.24 and tag in ('vehicle', 'person')
                 then tag || '_road' else tag end as tag,
            case when cam = 'garage-l' and t + h < 0.24 and tag in ('vehicle', 'person')
                 then 'road'
                 when cam = 'front entry' and tag = 'package' and cx < 0.178125
                 then 'in grass' end as ignore
          from det)""",
    "f5_road": f"select {_flat()}, raw_tag, round(road_y, 6) as road_y, ignore from roaded",
    "f6_valid": f"select {_flat()}, prob from valid",
    "f7_confidence": "select frame_id, model, box_no, class_id, conf from raw where conf > 0.4",
    "f8_sample_frames": f"""
        select {_flat()}, frame_no, prob from det where frame_no % 15 = 0 and prob > 0.6""",
    "f9_overdue_cameras": """
        select c.cam, c.interval_s, e.last_ts
        from (select 'u' || c_custkey as cam, cast(c_custkey % 50 * 1800 as int) as interval_s
              from customer) c
        left join (select 'u' || user_id as cam, max(ts) as last_ts from events group by 1) e
          on e.cam = c.cam
        where e.last_ts is null
           or epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(e.last_ts)
              > c.interval_s::bigint * 1000000""",
    "j1_exclusions": f"""
        with z as (
          select d.frame_id, d.det_no, e.tag = '*' as any_tag, e.ord,
                 coalesce(e.comment, case when e.tag = '*' then 'static' else
                   'static iou ' || cast({_box_iou('e', 'd')} as varchar) end) as reason
          from roaded d join excludes_t e on e.cam = d.cam and e.tag in ('*', d.tag)
          where {_box_iou('e', 'd')} > 0.5
          qualify row_number() over (partition by d.frame_id, d.det_no
                                     order by e.tag = '*', e.ord) = 1)
        select {_flat('d')}, coalesce(d.ignore, z.reason) as ignore
        from roaded d left join z on z.frame_id = d.frame_id and z.det_no = d.det_no""",
    "j2_frame_pairs": f"""
        select a.cam, a.tag, a.frame_no, a.frame_id, a.det_no, b.frame_id as prev_frame_id,
               b.det_no as prev_det_no, round({_box_iou('b', 'a')}, 6) as iou
        from det a join det b
          on a.cam = b.cam and a.tag = b.tag and a.frame_no = b.frame_no + 1
        where {_box_iou('b', 'a')} > 0.5""",
    "j3_asof_state": "select * from fst",
    "j4_flags": "select event_id, cam, flag_type, model, tags, frame_id, status from flf",
    "j5_match_plates": "select read_id, plate, known_plate, distance from matched",
    "j6_route_review": "select file, cam, model, tags, status, project_id from rt",
    "j7_labels": "select frame_id, det_no, tag_id, tag from det",
    "j8_lookup": f"""
        select d.frame_id, d.det_no, d.tag, coalesce(t.min_prob, {THRESHOLD}::double) as min_prob,
               coalesce(s.sound, 'pushover') as sound
        from det d left join thresholds_t t on t.tag = d.tag
        left join sounds_t s on s.tag = d.tag""",
    "a1_nms": f"select {_BOXES} from nms",
    "a1_nms_min_mode": f"select {_BOXES} from nms_min",
    "a2_nms_suppress": _picked("supp"),
    "a2_nms_suppress_crowded": _picked("supp3"),
    "a3_tag_counts": "select cam, frame_id, frame_ts, tag, count from counts",
    "a4_show_flag": 'select cam, frame_id, show_count, "show" from shows',
    "a5_object_sets": """
        select frame_id, cam, array_to_string(tags, ',') as tags,
               array_to_string(new_tags, ',') as new_tags from sets""",
    "a6_min_age": "select frame_id, cam, min_age from ages",
    "a7_alert_crop": """
        with e as (select frame_id, min(l - 0.05) * 1920 as x1, max(l + w + 0.05) * 1920 as x2,
                     min(t - 0.05) * 1080 as y1, max(t + h + 0.05) * 1080 as y2
                   from lnk group by frame_id),
        s as (select *, x1 + (x2 - x1) / 2 as cx, y1 + (y2 - y1) / 2 as cy,
                greatest(1920 / 4, x2 - x1) as sw0, greatest(1080 / 4, y2 - y1) as sh0 from e),
        a as (select *, greatest(0.0, least(x1, cx - sw0 / 2)) as x,
                greatest(0.0, y1) as y0 from s),
        b as (select *, least(sw0, 1920 - x) as sw, least(sh0, 1080 - y0) as sh from a),
        c as (select *, greatest(0.0, least(y0, cy - sh / 2)) as y from b)
        select frame_id, round(x, 6) as crop_left, round(y, 6) as crop_top,
               round(x + sw, 6) as crop_right, round(y + sh, 6) as crop_bottom from c""",
    "a7_vehicle_crop": """
        select frame_id, round(greatest(0, min(l - 0.05) * 1920), 6) as crop_left,
               round(greatest(0, min(t - 0.05) * 1080), 6) as crop_top,
               round(least(1920, max(l + w + 0.05) * 1920), 6) as crop_right,
               round(least(1080, max(t + h + 0.05) * 1080), 6) as crop_bottom
        from lnk where tag = 'vehicle' group by frame_id having bool_or(age < 3)""",
    "a8_frame_context": "select * from ctx",
    "a9_frame_priority": "select * from fpri",
    "a10_cycle_report": """
        select make_timestamp(epoch_us(f.frame_ts) // 30000000 * 30000000) as cycle_start,
               count(*) as frames, sum((f.frame_no % 7) / 64.0::double) as prediction_s,
               sum((f.frame_no % 3) / 8.0::double) as notify_s,
               string_agg(m.msg, ',' order by m.msg) as messages
        from (select frame_id, cam || '=[' || string_agg(tag || ':' || printf('%.2f', prob)
                || case when iou is not null then ':iou=' || printf('%.2f', iou) else '' end
                || ':age=' || age, ',' order by det_no) || ']' as msg
              from lnk group by frame_id, cam) m
        join frm f on f.frame_id = m.frame_id group by 1""",
    "a11_alpr_summary": """
        select response_id, array_to_string(plates, ',') as plates,
               case when len(plates) > 0 then 'Vehicle with plate '
                 || array_to_string(plates, ', ') else '' end as message,
               cast(count as int) as count from alpr""",
    "w1_tag_presence": f"""
        with thr as (select p.*, coalesce(t.min_prob, {THRESHOLD}) as thr
                     from prep p left join thresholds_t t on t.tag = p.raw_tag
                     where p.ignore is null and p.tag = p.raw_tag),
        fr as (select *, row_number() over (partition by cam order by frame_ts, frame_no) as n
               from frm),
        seen as (select f.cam, d.tag, f.n, f.frame_id, bool_or(d.prob > d.thr) as strong
                 from fr f join thr d on d.frame_id = f.frame_id
                 where d.prob > d.thr or d.prob > 0.4 group by all),
        run as (select *, n - row_number() over (partition by cam, tag order by n) as run
                from seen)
        select cam, tag, frame_id, bool_or(strong) over (partition by cam, tag, run order by n
          rows between unbounded preceding and current row) as present from run""",
    "w2_departed_tags": """
        select cam, frame_id, array_to_string(list_sort(gone), ',') as departed
        from (select *, list_filter(lag(tags) over w, lambda x: not list_contains(tags, x)) as gone,
                lag(priority) over w as prior
              from pri window w as (partition by cam order by frame_ts, frame_no))
        where len(gone) > 0 and prior > -3""",
    "w3_carry_priority": "select cam, frame_id, scored, priority from pri",
    "w4_count_changes": """
        select cam, tag, frame_id, frame_ts, count from counts
        qualify count is distinct from
          lag(count) over (partition by cam, tag order by frame_ts, frame_no)""",
    "w4_show_changes": """
        select cam, frame_id, show_count, "show" from shows
        qualify show_count <> coalesce(lag(show_count)
          over (partition by cam order by frame_ts, frame_no), -1)""",
    "w5_warmed_up": "select frame_id, cam, cam_age, cam_age > 2 as warm from warm",
    "w6_frame_before": """
        with s as (select f.*, f.frame_id in (select frame_id from save) as saved from frm f)
        select cam, frame_id, p as prior_frame_id, pts as prior_frame_ts
        from (select *, lag(frame_id) over w as p, lag(frame_ts) over w as pts,
                lag(saved) over w as ps
              from s window w as (partition by cam order by frame_ts, frame_no))
        where saved and not ps""",
    "w7_capture_health": f"""
        with a as (select cam, make_timestamp(({START_S} + seq * {STEP_S}) * 1000000) as ts,
                     event_type not in ('error', 'signup') as ok from num),
        r as (select *, sum(ok::int) over (partition by cam order by ts) as run from a),
        k as (select *, row_number() over (partition by cam, run, ok order by ts) as n from r)
        select cam, ts, ok, case when ok then 0 else n end as fails,
               case when ok then 0.0::double else pow(2.0, n - 1) end as skip,
               not ok and pow(2.0, n - 1) > 3 as reboot from k""",
    "w8_throttle": """
        select event_type, user_id, e.event_id, e.ts
        from (select event_type, user_id, unnest(list_reduce(l,
                lambda acc, x: case when len(acc) = 0 or x.us - acc[-1].us > 86400000000
                               then list_append(acc, x) else acc end, l[1:0])) as f
              from (select event_type, user_id, list({'us': epoch_us(ts), 'id': event_id}
                      order by ts, event_id) as l from events group by all)) t
        join events e using (event_type, user_id) where e.event_id = t.f.id""",
    "k1_oldest_frame": """
        select cam, frame_id, source from frm
        qualify row_number() over (partition by cam order by frame_ts, frame_no) = 1""",
    "x1_box_iou": f"""
        select d.frame_id, d.det_no, e.tag as ztag, e.ord, round({_box_iou('e', 'd')}, 6) as iou
        from det d join excludes_t e on e.cam = d.cam""",
    "x2_box_iou_px": """
        with p as (select frame_id, det_no, cast(l * 512 as int) as x1, cast(t * 512 as int) as y1,
                     cast((l + w) * 512 as int) as x2, cast((t + h) * 512 as int) as y2 from det),
        q as (select *, greatest(0, x2 - (x1 + 20) + 1) * greatest(0, y2 - y1 + 1) as i,
                (x2 - x1 + 1) * (y2 - y1 + 1) as a, (x2 - (x1 + 20) + 1) * (y2 - y1 + 1) as b
              from p)
        select frame_id, det_no,
               round(case when a + b - i = 0 then 0.0 else i / (a + b - i)::double end, 6) as iou
        from q""",
    "x3_polyline_y": """
        select d.frame_id, d.det_no, round(r.road_y, 6) as road_y
        from det d left join road_hit r on r.frame_id = d.frame_id and r.det_no = d.det_no""",
    "x4_parse_road": """
        select d.frame_id, d.det_no, d.cam, c.road_mode, cast(p.k as int) as points,
               round(p.s, 6) as sum_xy
        from det d join cams c on c.cam = d.cam
        left join (select cam, count(*) as k, sum(x + y) as s from road_pts group by cam) p
          on p.cam = c.cam""",
    "x7_decode_grid": """
        select frame_id, row, col, anchor, round(bx - bw / 2, 6) as left,
               round(bym - bh / 2, 6) as top, round(bw, 6) as width, round(bh, 6) as height,
               round(e0 / (e0 + e1 + e2 + e3) * ob, 6) as p0,
               round(e1 / (e0 + e1 + e2 + e3) * ob, 6) as p1,
               round(e2 / (e0 + e1 + e2 + e3) * ob, 6) as p2,
               round(e3 / (e0 + e1 + e2 + e3) * ob, 6) as p3 from gdec""",
    "x8_corner_box": """
        select frame_id, model, box_no, round(round(x1, 8), 6) as left,
               round(round(y1, 8), 6) as top, round(round(x2 - x1, 8), 6) as width,
               round(round(y2 - y1, 8), 6) as height from raw""",
    "x9_small_hours": """
        select event_id, extract(hour from ts) < 6 as small_hours from events""",
    "x10_mode": "select frame_id, mode from fst",
    "x11_edit_variants": """
        with abc as (select unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '')) as c),
        v as (select plate, ord, unnest([
                  substr(plate, 1, i) || substr(plate, i + 2),
                  substr(plate, 1, i) || c || substr(plate, i + 2),
                  substr(plate, 1, i) || c || substr(plate, i + 1),
                  plate || c]) as w
              from known, (select unnest(range(8)) as i), abc)
        select distinct plate, ord, w as variant from v""",
    "x12_location": """
        select frame_id, array_to_string(tags, ',') || ' ' || case cam
            when 'driveway' then 'in driveway' when 'garage' then 'in garage'
            when 'shed' then 'in front of garage' when 'garage-r' then 'in front of left garage'
            when 'garage-l' then 'in front of right garage' else 'near ' || cam end as message
        from sets where len(tags) > 0""",
    "x13_departure_text": """
        with s as (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id
                       order by ts, event_id))) // 1000000 as s from events)
        select event_id, event_type || ' departed from ' || user_id || ' after being seen '
          || event_id || ' times over the past ' || case
            when s < 60 then case when s = 1 then 'a second' else s || ' seconds' end
            when s < 3600 then case when s // 60 = 1 then 'minute' else s // 60 || ' minutes' end
            when s < 86400 then case when s // 3600 = 1 then 'an hour'
                                     else s // 3600 || ' hours' end
            else case when s // 86400 = 1 then 'a day' else s // 86400 || ' days' end end as msg
        from s where s is not null""",
    "x14_labels": """
        select frame_id, cam || '=[' || string_agg(tag || ':' || printf('%.2f', prob)
            || case when iou is not null then ':iou=' || printf('%.2f', iou) else '' end
            || ':p=' || priority || coalesce(':pt=' || priority_type, '')
            || ':age=' || age, ',' order by det_no) || ']' as message
        from sc group by frame_id, cam""",
    "x15_percent": """
        select frame_id, det_no, printf('%s %.1f%%', tag, prob * 100) as label from det""",
    "x16_names": """
        select frame_id, replace(cam, ' ', '_') as key, frame_no || '.jpg' as base,
               cast(frame_no as varchar) as stem from frm""",
    "x17_short_name": "select frame_id, replace(cam, ' ', '-') as name from frm",
    "x18_review_link": """
        select frame_id, 'http://review/flag?file=' || frame_id || '.jpg&model=color&cam='
          || replace(cam, ' ', '_') || '&tags=' || array_to_string(tags, ',') as url from sets""",
    "x19_sighting_name": """
        select frame_id, strftime(frame_ts, '%H%M%S') || '-' || replace(cam, ' ', '_') || '-'
            || array_to_string(tags, '_') as name,
          strftime(frame_ts, '%H%M%S') || '-' || replace(cam, ' ', '_') || '-'
            || array_to_string(tags, '_') || '-prior' as prior_name from sets""",
    "l3_vehicle_phrases": "select response_id, pos, plate, phrase from phr",
    "t1_track": """
        select k.f as frame_id, k.cam, k.d as det_no, k.tag, k.fl as left, k.ft as top,
               k.fw as width, k.fh as height, k.cam || '|' || k.tag || '|' || k.f || '|' || k.d
                 as track_id,
               null::double as iou, k.fa as age, true as is_new, make_timestamp(k.st) as start_ts
        from trk k
        union all
        select o.f, o.cam, o.d, o.tag, v.l, v.t, v.w, v.h,
               o.cam || '|' || o.tag || '|' || o.tf || '|' || o.td, round(o.iou, 6), o.age, false,
               make_timestamp(o.st)
        from tout o join valid v on v.frame_id = o.f and v.det_no = o.d""",
    "t2_departures": """
        select cam, tag, cam || '|' || tag || '|' || f || '|' || d as track_id, start_ts, last_ts,
               age, departed_ts from tdep""",
    "t3_departure_alerts": f"""
        select cam || '|' || tag || '|' || f || '|' || d as track_id, departed_ts, msg
        from ({_told("tdep")})""",
    "p0_known_detections": "select frame_id, det_no, tag, priority from sc where not scored",
    "p1_scores": "select frame_id, det_no, tag, priority, priority_type, scored from sc",
    "p1b_scores_all_new": "select frame_id, det_no, tag, priority, priority_type, scored from scn",
    "p2_frame_alerts": "select cam, frame_id, mode, message, priority, sound, push from al",
    "p2_departure_alerts": """
        select cam, frame_id, frame_ts, message, priority, sound, push from dalp""",
    "p3_frame_sound": "select frame_id, sound from snd",
    "p4_pushes": """
        select cam, frame_id, priority, sound, 'http://review/flag?file=' || frame_id
          || '.jpg&model=color&cam=' || replace(cam, ' ', '_') || '&tags='
          || array_to_string(tags, ',') as url
        from al where push""",
    "p5_plate_gate": """
        select frame_id, visible_vehicles from ctx
        where visible_vehicles > 0 and frame_id in (select frame_id from gate)""",
    "p6_announcements": """
        select x.*, x.phrase || ' ' || case when x.cam = 'shed' then 'in front of garage'
                                            else 'in driveway' end as spoken
        from told2 x join fst f on f.frame_id = x.frame_id
        where f.vehicle_detector = 'on' and f.presence = 'home' and x.cam <> 'mailbox'""",
    "p7_species": """
        select distinct cam, frame_id, frame_ts, tag from lnk where is_new and tag = 'deer'""",
    "p7_owner_arrivals": """
        with h as (select distinct m.ts from matched m join known k on k.plate = m.known_plate
                   where k.color = 'machinery'),
        f as (select list(epoch_us(ts) order by ts) as l from h)
        select 'machinery' as owner, make_timestamp(unnest(list_reduce(l,
          lambda acc, x: case when len(acc) = 0 or x - acc[-1] > 31536000000000
                         then list_append(acc, x) else acc end, l[1:0]))) as ts from f""",
    "p8_saved": """
        select frame_id, cam, priority, array_to_string(tags, ',') as tags, min_age,
               strftime(frame_ts, '%H%M%S') || '-' || replace(cam, ' ', '_') || '-'
                 || array_to_string(tags, '_') as name from save""",
    "c1_catalogue": """
        select *, '{"name":"' || title || '","state_topic":"' || topic || '","uniq_id":"' || uniq_id
          || '"' || coalesce(',"icon":"' || icon || '"', '') || '}' as payload from (
        with c as (select * from cams where cam in (select cam from det))
        select x.cam, x.tag, 'sensor' as kind, x.key || '-' || x.tag as uniq_id,
          list_reduce(list_transform(string_split(x.cam || ' ' || x.tag || ' count', ' '),
             lambda p: array_to_string(list_transform(string_split(p, '-'),
               lambda q: upper(q[1]) || q[2:]), '-')), lambda a, b: a || ' ' || b) as title,
          x.key || '/' || x.tag || '/count' as topic, coalesce(i.icon, 'mdi:' || x.tag) as icon
        from (select cam, replace(cam, ' ', '_') as key, unnest(publish) as tag from c) x
        left join icons_t i on i.tag = x.tag where x.tag <> ''
        union all
        select cam, null, 'binary_sensor', 'show-' || replace(cam, ' ', '_'),
          'Show ' || list_reduce(list_transform(string_split(cam, ' '),
             lambda p: array_to_string(list_transform(string_split(p, '-'),
               lambda q: upper(q[1]) || q[2:]), '-')), lambda a, b: a || ' ' || b),
          replace(cam, ' ', '_') || '/show', null from c)""",
    "c2_review_queue": """
        select file, status, project_id, replace(file, '.jpg', '') as name,
               replace(cam, ' ', '_') || ',' || model as upload_tags from rt""",
    "e2_all_pushes": """
        select cam, frame_id, frame_ts, 'new' as kind, message, priority, sound from al where push
        union all
        select cam, frame_id, frame_ts, 'departed', message, priority, sound from dalp
        where push""",
}
ORACLE["e1_count_changes"] = ORACLE["w4_count_changes"]
_KEPT = ORACLE["f3_hysteresis"]
CTES["vkept"] = f"""
        select v.* from valid v join ({_KEPT}) k
          on k.frame_id = v.frame_id and k.det_no = v.det_no"""
ORACLE["e2_hysteresis_counts"] = f"""
    with kept as ({_KEPT}),
    c as (select p.*, count(d.frame_id) as count
          from pub p left join (select * from kept where ignore is null) d
            on d.frame_id = p.frame_id and d.tag = p.tag group by all)
    select cam, tag, frame_id, frame_ts, count from c
    qualify count is distinct from
      lag(count) over (partition by cam, tag order by frame_ts, frame_no)"""


def _needed(sql: str) -> list[str]:
    """Building blocks a statement uses, in dependency order."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[a-z_0-9]+", text)):
            if word in CTES and word not in found:
                found.add(word)
                visit(CTES[word])

    visit(sql)
    return [n for n in CTES if n in found]


def statement(name: str) -> str:
    """Self-contained SQL of one query."""
    sql = ORACLE[name]
    blocks = ",\n".join(f"{n} as ({CTES[n]})" for n in _needed(sql))
    return f"with {blocks}\nselect * from ({sql})" if blocks else sql


def oracle_sql() -> dict[str, str]:
    return {name: statement(name) for name in ORACLE}
