"""Schemas of the engine's tables, as DDL strings."""

ARGUMENTS = "array<struct<name:string,type:string,required:boolean>>"
PARAMS = "array<struct<name:string,description:string,type:string,required:boolean>>"

FILES = "uri string, text string"
DOCUMENTS = "session_id string, uri string, text string, seq long"
DOC_CHANGES = "seq long, session_id string, op string, uri string, changes array<string>"
FOLDER_CHANGES = "seq long, op string, uri string, name string"
REQUESTS = "req_id long, method string, uri string, line int, character int, trigger_kind string, trigger_char string, query string"
CATALOG = f"name string, description string, syntax string, returns string, type string, params {PARAMS}"
FUNCTION_DEFS = f"uri string, ord int, name string, name_key string, line int, arguments {ARGUMENTS}"
CONFIG = "workspaceName string, workspacePaths array<string>, workspaceIndexGlobs array<string>"
MANIFEST = "table string, bucket int, version int"
LINES = "lot string, line string"
_FOLDERS = "array<struct<uri:string,name:string>>"
_PARAMS = f"struct<textDocument:struct<uri:string,text:string>,contentChanges:array<struct<text:string>>,event:struct<added:{_FOLDERS},removed:{_FOLDERS}>>"
NOTIFICATION = f"seq long, at long, session_id string, message struct<method:string,params:{_PARAMS}>"
PACKED_CHANGES = "bucket int, rows binary"
STORED = "session_id array<string>, uri array<string>, text array<string>, seq array<bigint>, at array<bigint>"
STORE_UPDATES = "session_id array<string>, uri array<string>, text array<string>, seq array<bigint>"
