"""Schemas of the canonical tables."""

THINGS = (
    "id string, graph_id string, title string, types array<string>, created timestamp, "
    "modified timestamp, doc variant"
)
TD_NODES = (
    "id string, path array<string>, depth int, parent array<string>, key string, pos int, "
    "kind string, v_str string, v_num double, v_bool boolean"
)
QUADS = (
    "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string, "
    "o_num double, o_ts timestamp"
)
OPS = "seq bigint, op string, id string, body string, ts timestamp"
EVENTS = "seq bigint, event string, thing_id string, data string, ts timestamp"
VIOLATIONS = (
    "g string, focus_node string, shape string, path string, constraint string, "
    "value string, message string"
)
REJECTS = (
    "seq bigint, id string, code string, message string, "
    "errors array<struct<field:string,description:string>>"
)

QUAD_COLS = ["g", "s", "p", "o", "o_kind", "o_dt", "o_lang", "o_num", "o_ts"]
QUAD_KEY = ["g", "s", "p", "o", "o_kind", "o_dt", "o_lang"]
