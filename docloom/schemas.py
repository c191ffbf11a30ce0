"""StructTypes of the data model, as DDL strings that Spark accepts as schemas."""

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
OBJECTS = (
    "part string, slide string, ordinal int, shape_id string, name string, type string, z_order int, group_path array<string>, "
    "x long, y long, cx long, cy long, transform_reliable boolean, rotation double, flip_h boolean, flip_v boolean, "
    "crop_left long, crop_top long, crop_right long, crop_bottom long, inside_group boolean, has_extension boolean, has_timing_reference boolean, "
    "relationships array<struct<id:string,type:string,target:string,target_mode:string,content_type:string>>, blip_sources array<string>, "
    "media_sha256 string, media_valid boolean, xml_sha256 string"
)
NODES = "page long, node long, kind string, parent long, state string, x int, y int, w int, h int, z int"
TEXT_ITEMS = "page long, ord int, x int, y int, w int, h int, text string, font_size double, color string, bold boolean, confidence double"
PROPOSALS = "page long, ord int, x1 double, y1 double, x2 double, y2 double, score double, label string, role string, source string, edge boolean"
TRACE = "schema_version int, event string, stage string, page_id string, model string, operation_count long, duration_ms long, status string, image_count long, total_bytes long, platform string, device string, cuda_available boolean, mps_available boolean"
MASK_CELLS = "page long, y int, x int"
DECISIONS = "page long, object long, decision string, category string, confidence double, evidence array<string>"
