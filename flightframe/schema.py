"""Column types of the tables the operators read from outside."""

from __future__ import annotations

RAW_FRAME = "url string, image_url string, video_name string"
RAW_TRANSLATION = (
    "url string, image_url string, health_status string, "
    "translation_x string, translation_y string, translation_z string"
)
ANNOTATION = (
    "filename string, size struct<width:string,height:string>, object array<struct<"
    "motion:string,motion_status:string,hareket:string,name:string,class:string,"
    "bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string,x1:string,y1:string,x2:string,y2:string>,"
    "bbox:struct<xmin:string,ymin:string,xmax:string,ymax:string,x1:string,y1:string,x2:string,y2:string>>>"
)
PAIR_TRUTH = "reference_id string, frame_name string, expected_match string"
# Known payload fields.
FRAME_FIELDS = ("url", "image_url", "video_name")
TRANSLATION_FIELDS = ("url", "image_url", "health_status", "translation_x", "translation_y", "translation_z")
