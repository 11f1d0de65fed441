"""Relations of the engine, in one place.

A snapshot is a value of the ``snapshot`` column (``base`` and ``cur`` in a comparison), nodes are keyed by path.
"""

FILES = "snapshot string, path string, content binary"
NODES = "snapshot string, path string"
EDGES = "snapshot string, src string, dst string, conditional boolean, ordinal int"
DIRECTIVES = "snapshot string, src string, ordinal int, kind string, token string, line int, conditional boolean"
DIAGNOSTICS = "snapshot string, src string, kind string, raw string, line int"
RESOLVED = "snapshot string, src string, ordinal int, kind string, token string, line int, conditional boolean, resolution string, target string, candidates array<string>"
FUNCTIONS = "snapshot string, path string, ordinal int, qualified_name string, param_fp string, arity int, start_line int, end_line int, loc int, score int, structural int, max_nesting int"
BOOL_FIELDS = "snapshot string, path string, struct string, field string, line int"
STRUCTS = "snapshot string, path string, struct string"
FRAGMENTS = "frag_id long, file string, start_line int, end_line int, token_count int, stmts int, bag map<string,int>, seq array<string>, raw_seq array<string>, norm_lines array<string>, norm_line_seq array<string>, diversity double"
DIFF_LINES = "side string, path string, line int, text string"
NUMSTAT = "path string, added int, removed int"
COMMITS = "pos int, sha string, subject string"
CHANGES = "pos int, path string, added int, deleted int"
VIOLATIONS = "rule string, file string, line int, message string"
