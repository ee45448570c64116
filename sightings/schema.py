"""Record layouts shared by the operators."""

from __future__ import annotations

BOX = "struct<left:double,top:double,width:double,height:double>"
POINT = "struct<x:double,y:double>"

FRAME = (
    "frame_id long, cam string, frame_no long, frame_ts timestamp, is_grey boolean, "
    "source string, hash string"
)
CAMERA = (
    "cam string, interval_s int, vehicle_check boolean, road_mode string, "
    f"road_line array<{POINT}>, publish array<string>"
)
DETECTION = (
    "frame_id long, cam string, frame_no long, frame_ts timestamp, det_no int, "
    f"tag_id int, tag string, prob double, box {BOX}"
)
EXCLUDE = f"cam string, tag string, ord int, box {BOX}, comment string"
KNOWN_PLATE = (
    "plate string, ord int, owner string, color string, make string, model string, "
    "announce boolean"
)

PREDICTION = (
    "struct<probability:double,tagId:int,tagName:string,boundingBox:" + BOX + ","
    "center:" + POINT + ",camName:string,road_y:double,ignore:string,iou:double,age:int,"
    "priority:int,priority_type:string,start_time:string,last_time:string>"
)
SIDECAR = f"source string, time string, predictions array<{PREDICTION}>"

# Order of the frames of one camera, and of the detections within it.
FRAME_ORDER = ["frame_ts", "frame_no"]
DETECTION_ORDER = ["frame_ts", "frame_no", "det_no"]
