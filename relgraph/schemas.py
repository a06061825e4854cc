"""Schemas of the graph's tables. Missing values are "", 0, false or [], never null."""

NODES = "path string, language string, file_type string, size bigint, mtime double, sha256 string, description string, always_include boolean, symbols array<string>, http_routes array<string>, http_calls array<string>"
IMPORT = "struct<module:string,level:int,symbols:array<string>,local_names:array<string>,is_relative:boolean,base_classes:array<string>,is_reexport:boolean>"
EXTRACTS = f"path string, imports array<{IMPORT}>, defined_symbols array<string>, usage_counts map<string,int>, docstring string, has_inheritance boolean, error string, http_routes array<string>, http_calls array<string>"
EDGES = "src string, dst string, weight int, relations array<string>, confidence string, symbol_count int, usage int"
FILES = "path string, language string, size bigint, mtime double, sha256 string, content binary"
