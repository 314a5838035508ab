"""Queries over the test tables for the column functions: names, paths, positions, quotes, colours, codes, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dimensions, nested, text, values
from ..operators import windows
from .registry import Tables, query

# Names

SIGNED = "SELECT p_partkey, substr('$@%&x', (p_partkey % 5 + 1)::INT, 1) || p_brand AS name FROM part"


@query(f"SELECT p_partkey, nullif(regexp_extract(name, '^([$@%&])', 1), '') AS sigil, regexp_replace(name, '^[$@%&]', '') AS bare, CASE left(name, 1) WHEN '@' THEN 'Array' WHEN '%' THEN 'Hash' ELSE 'Scalar' END AS kind FROM ({SIGNED})")
def variable_names(t):
    name = F.concat(F.substring(F.lit("$@%&x"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1)), "p_brand")
    return t.part.select("p_partkey", text.sigil(name).alias("sigil"), text.bare_name(name).alias("bare"), text.variable_kind(text.sigil(name)).alias("kind"))


@query("SELECT n_nationkey, 'Main::' || replace(n_name, '_', '::') AS name FROM nation")
def legacy_names(t):
    return t.nation.select("n_nationkey", text.legacy_separator(F.concat(F.lit("Main'"), F.replace("n_name", F.lit("_"), F.lit("'")))).alias("name"))


@query("""SELECT p_partkey, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') AS is_name, name NOT IN ('print', 'sort', '_') AS can_rename
 FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'print' WHEN 1 THEN '_' || p_size WHEN 2 THEN p_name WHEN 3 THEN '_' ELSE replace(p_name, ' ', '_') END AS name FROM part)""")
def identifiers(t):
    name = F.when(F.col("p_partkey") % 5 == 0, "print").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("_"), "p_size")).when(F.col("p_partkey") % 5 == 2, F.col("p_name")).when(F.col("p_partkey") % 5 == 3, "_").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return t.part.select("p_partkey", text.is_identifier(name).alias("is_name"), text.can_rename(name).alias("can_rename"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || '::' || p_brand ELSE p_name END AS module FROM part""")
def modules_of_paths(t):
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("file:///srv/lib/old/lib/"), "p_type", F.lit("/"), "p_brand", F.lit(".pm"))).otherwise(F.concat(F.lit("/srv/bin/"), "p_name", F.lit(".pl")))
    return t.part.select("p_partkey", text.module_of_path(path).alias("module"))


@query(r"""SELECT p_partkey, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS words
 FROM (SELECT p_partkey, p_type || 'Part_' || p_brand || '::' || replace(p_name, ' ', 'HTTPServer') AS n FROM part)""")
def name_words(t):
    name = F.concat("p_type", F.lit("Part_"), "p_brand", F.lit("::"), F.replace("p_name", F.lit(" "), F.lit("HTTPServer")))
    return t.part.select("p_partkey", text.word_tokens(name).alias("words"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [n_name] WHEN 1 THEN ['Base', n_name] ELSE [n_name] END AS parents FROM nation")
def parent_lists(t):
    argument = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("'"), "n_name", F.lit("'"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("qw( Base "), "n_name", F.lit(" )"))).otherwise(F.concat(F.lit('"'), "n_name", F.lit('"')))
    return t.nation.select("n_nationkey", text.names_of_list(argument).alias("parents"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Data::Dumper' WHEN 1 THEN 'JSON' END AS module FROM customer")
def guessed_modules(t):
    called = F.when(F.col("c_custkey") % 3 == 0, "dumper").when(F.col("c_custkey") % 3 == 1, "decode_json").otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", text.lookup(called, dimensions.GUESSED_MODULES).alias("module"))


# Paths and URIs

PATHS = "SELECT p_partkey, '/repo/' || CASE p_size % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.git/' ELSE 'lib/' END || p_name || CASE p_partkey % 5 WHEN 0 THEN '.pm' WHEN 1 THEN '.PL' WHEN 2 THEN '.t' WHEN 3 THEN '.txt' ELSE '' END AS path FROM part"


def paths(t: Tables) -> DataFrame:
    folder = F.when(F.col("p_size") % 4 == 0, "node_modules/").when(F.col("p_size") % 4 == 1, ".git/").otherwise("lib/")
    ending = F.when(F.col("p_partkey") % 5 == 0, ".pm").when(F.col("p_partkey") % 5 == 1, ".PL").when(F.col("p_partkey") % 5 == 2, ".t").when(F.col("p_partkey") % 5 == 3, ".txt").otherwise("")
    return t.part.select("p_partkey", F.concat(F.lit("/repo/"), folder, "p_name", ending).alias("path"))


@query(f"SELECT p_partkey, path FROM ({PATHS}) WHERE regexp_matches(lower(path), '\\.(pl|pm|t|psgi)$') AND NOT regexp_matches(path, '/(node_modules|\\.git)/')")
def discovered_files(t):
    return paths(t).filter(text.is_source_file(F.col("path")) & ~text.is_skipped_folder(F.col("path")))


@query(f"SELECT p_partkey, 'file://' || replace(path, ' ', '%20') AS uri, path AS back FROM ({PATHS})")
def uri_round_trip(t):
    uri = text.path_to_uri(F.col("path"))
    return paths(t).select("p_partkey", uri.alias("uri"), text.uri_to_path(uri).alias("back"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'file:///c:/' ELSE 'file:///srv/' END || p_brand AS key FROM part")
def uri_keys(t):
    uri = F.concat(F.when(F.col("p_size") % 2 == 0, "file:///C:/").otherwise("file:///srv/"), "p_brand")
    return t.part.select("p_partkey", text.uri_key(uri).alias("key"))


@query("SELECT p_partkey, p_size % 3 <> 2 AS same FROM part")
def matching_paths(t):
    stored = F.concat(F.lit("/srv/"), "p_brand", F.lit("/"), "p_name")
    seen = F.when(F.col("p_size") % 3 == 0, stored).when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit("/"), "p_name")).otherwise(F.concat("p_name", F.lit("!")))
    return t.part.select("p_partkey", text.paths_match(stored, seen).alias("same"))


# Positions

AT = "SELECT doc_id, text, left(text, (doc_id * 37 % 900)::INT) AS before FROM documents WHERE text IS NOT NULL"


def before(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", "text", F.expr("left(text, cast(doc_id * 37 % 900 as int))").alias("before"))


@query(rf"""SELECT doc_id, strlen(before)::BIGINT AS byte_offset, (length(before) - length(replace(before, chr(10), '')))::INT AS line,
 (length(l) + len(regexp_extract_all(l, '[\x{{10000}}-\x{{10FFFF}}]')))::INT AS col FROM (SELECT *, string_split(before, chr(10))[-1] AS l FROM ({AT}))""")
def editor_positions(t):
    rows = before(t).withColumn("byte_offset", F.octet_length("before").cast("long"))
    at = text.position_of(F.col("text"), F.col("byte_offset"))
    rows = rows.withColumns({"line": at["line"], "col": at["column"]})
    # There and back: a position gives the offset that it was made of.
    return rows.select("doc_id", values.byte_offset("text", "line", "col").alias("byte_offset"), "line", "col")


@query(f"SELECT doc_id, contains(string_split(before, chr(10))[-1], '#') AS in_comment, ((length(before) - length(replace(before, '''', ''))) % 2 = 1 OR (length(before) - length(replace(before, '\"', ''))) % 2 = 1) AS in_string FROM ({AT})")
def comment_and_string(t):
    at = F.length("before")
    return before(t).select("doc_id", text.in_comment(F.col("text"), at).alias("in_comment"), text.in_string(F.col("text"), at).alias("in_string"))


@query("SELECT page_id, strpos(html, '<') - 1 AS opening, strpos(html, '>') - 1 AS closing FROM pages WHERE strpos(html, '>') > strpos(html, '<') AND strpos(html, '<') > 0")
def linked_delimiters(t):
    rows = t.pages.filter("instr(html, '>') > instr(html, '<') and instr(html, '<') > 0")
    pair = values.matching_pair("html", F.instr("html", "<") - 1)
    return rows.select("page_id", pair["opening"].cast("long").alias("opening"), pair["closing"].cast("long").alias("closing"))


# Trees as text

SEXP = "'(source (' || p_type || '  (name) (' || CASE WHEN p_size % 2 = 0 THEN 'number' ELSE 'string (x)' END || ')  ) )'"


@query(f"SELECT p_partkey, regexp_extract_all(s, '\\(([A-Za-z_]\\w*)', 1) AS kinds, (length(s) - length(replace(s, '(', '')))::INT AS nodes, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS sexp FROM (SELECT p_partkey, {SEXP} AS s FROM part)")
def tree_texts(t):
    s = F.concat(F.lit("(source ("), "p_type", F.lit("  (name) ("), F.when(F.col("p_size") % 2 == 0, "number").otherwise("string (x)"), F.lit(")  ) )"))
    return t.part.select("p_partkey", text.node_types(s).alias("kinds"), text.node_count(s).alias("nodes"), text.normal_sexp(s).alias("sexp"))


@query(r"SELECT doc_id, length(text)::INT AS characters, len(regexp_extract_all(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]'))::INT AS emoji, len(regexp_extract_all(text, '[\x{0250}-\x{10FFFF}]'))::INT AS beyond_latin FROM documents WHERE text IS NOT NULL")
def unicode_complexity(t):
    c = text.text_complexity(F.col("text"))
    return t.documents.filter("text is not null").select("doc_id", c["characters"].alias("characters"), c["emoji"].alias("emoji"), c["beyond_latin"].alias("beyond_latin"))


# Quotes and patterns

FLAG = "CASE p_size % 3 WHEN 0 THEN 'gi' WHEN 1 THEN 'x' ELSE '' END"


def flags() -> F.Column:
    return F.when(F.col("p_size") % 3 == 0, "gi").when(F.col("p_size") % 3 == 1, "x").otherwise("")


@query(f"SELECT p_partkey, p_name AS body, {FLAG} AS flags FROM part")
def pattern_literals(t):
    kind = F.col("p_partkey") % 4
    literal = F.concat(F.when(kind == 0, "m/").when(kind == 1, "qr{").when(kind == 2, "m!").otherwise("/"), "p_name", F.when(kind == 1, "}").when(kind == 2, "!").otherwise("/"), flags())
    parts = text.regex_parts(literal)
    return t.part.select("p_partkey", parts["body"].alias("body"), parts["flags"].alias("flags"))


@query(f"SELECT p_partkey, p_name AS pattern, p_type AS replacement, {FLAG} AS flags, p_size % 5 <> 0 AS valid FROM part")
def substitutions(t):
    kind = F.col("p_partkey") % 3
    literal = F.concat(F.when(kind == 0, "s/").when(kind == 1, "s{").otherwise("tr,"), "p_name", F.when(kind == 0, "/").when(kind == 1, "}{").otherwise(","), "p_type", F.when(kind == 0, "/").when(kind == 1, "}").otherwise(","), flags())
    parts = text.substitution_parts(literal)
    valid = text.valid_flags(F.concat(parts["flags"], F.when(F.col("p_size") % 5 == 0, "Z").otherwise("")))
    return t.part.select("p_partkey", parts["pattern"].alias("pattern"), parts["replacement"].alias("replacement"), parts["flags"].alias("flags"), valid.alias("valid"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS runs_code, p_partkey % 4 = 1 AS nested FROM part")
def pattern_risks(t):
    kind = F.col("p_partkey") % 4
    pattern = F.concat("p_type", F.when(kind == 0, "(?{ print })").when(kind == 1, "(a+)+").when(kind == 2, r"\(?{ x }").otherwise("(a+b)?"))
    return t.part.select("p_partkey", text.runs_code(pattern).alias("runs_code"), text.nested_quantifiers(pattern).alias("nested"))


# Colours

STYLE = "p_type || ' #' || printf('%06X', (p_partkey * 7919 % 16777216)::INT) || chr(10) || p_name || ' = \"' || CASE p_size % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'teal' ELSE 'orange' END || '\" or \"x\"; ' || CASE WHEN p_size % 2 = 0 THEN '#fff' ELSE '#ggg' END"


def styles(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, "Red").when(F.col("p_size") % 3 == 1, "teal").otherwise("orange")
    style = F.concat("p_type", F.lit(" #"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"), F.lit("\n"), "p_name", F.lit(' = "'), name, F.lit('" or "x"; '), F.when(F.col("p_size") % 2 == 0, "#fff").otherwise("#ggg"))
    return t.part.select("p_partkey", style.alias("text"))


@query(f"""WITH s AS (SELECT p_partkey, string_split({STYLE}, chr(10)) AS l FROM part), m AS (SELECT p_partkey, i - 1 AS line, l[i] AS l FROM s, unnest([1, 2]) AS u(i))
 SELECT p_partkey, line::INT AS line, (strpos(l, '#') - 1)::INT AS start, regexp_extract(l, '#([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{3}})\\b') AS color, length(regexp_extract(l, '#([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{3}})\\b'))::INT AS length FROM m WHERE regexp_matches(l, '#([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{3}})\\b')""")
def hex_color_scan(t):
    return text.hex_colors(styles(t), ["p_partkey"], "text").select("p_partkey", "line", "start", "color", "length")


@query("""SELECT p_partkey, 1 AS line, CASE WHEN p_size % 3 = 0 THEN 'red' ELSE 'orange' END AS name, (length(p_name) + 4)::INT AS start FROM part WHERE p_size % 3 <> 1""")
def named_color_scan(t):
    return text.named_colors(styles(t), ["p_partkey"], "text").select("p_partkey", "line", "name", "start")


@query("SELECT p_partkey, (30 + p_size % 8)::INT AS code, (length(p_name))::INT AS start FROM part")
def ansi_color_scan(t):
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit("\x1b["), (30 + F.col("p_size") % 8).cast("string"), F.lit("m!")).alias("text"))
    return text.ansi_colors(rows, ["p_partkey"], "text").select("p_partkey", "code", "start")


RGB = "SELECT DISTINCT p_size * 5 % 256 AS r, p_partkey * 3 % 256 AS g, p_partkey * 11 % 256 AS b FROM part"


@query(f"""WITH c AS (SELECT r, g, b, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM ({RGB})), m AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM c)
 SELECT r, g, b, round(CASE WHEN hi = lo THEN 0 WHEN hi = x THEN CASE WHEN y >= z THEN (y - z) / (hi - lo) ELSE (y - z) / (hi - lo) + 6 END WHEN hi = y THEN (z - x) / (hi - lo) + 2 ELSE (x - y) / (hi - lo) + 4 END * 60)::INT AS hue,
 round((hi + lo) / 2 * 100)::INT AS lightness FROM m""")
def hsl_colors(t):
    rows = t.part.select((F.col("p_size") * 5 % 256).alias("r"), (F.col("p_partkey") * 3 % 256).alias("g"), (F.col("p_partkey") * 11 % 256).alias("b")).distinct()
    c = text.hsl(*(F.col(x) / 255.0 for x in "rgb"))
    return rows.select("r", "g", "b", c["hue"].alias("hue"), c["lightness"].alias("lightness"))


# Codes and messages


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'MissingStrict' WHEN 1 THEN 'UndefinedVariable' WHEN 2 THEN 'CriticSeverity3' END AS name, CASE p_size % 4 WHEN 0 THEN 'Warning' WHEN 1 THEN 'Error' WHEN 2 THEN 'Hint' END AS severity, CASE p_size % 4 WHEN 0 THEN 'StrictWarnings' WHEN 1 THEN 'StrictWarnings' WHEN 2 THEN 'PerlCritic' END AS category FROM part")
def diagnostic_codes(t):
    code = F.when(F.col("p_size") % 4 == 0, "PL100").when(F.col("p_size") % 4 == 1, "PL103").when(F.col("p_size") % 4 == 2, "PC003").otherwise("XX")
    return t.part.select("p_partkey", code.alias("code")).join(F.broadcast(dimensions.dim_diag_code(t.spark)), "code", "left").drop("code")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 4 WHEN 1 THEN 13 WHEN 2 THEN 14 END AS code, CASE p_size % 4 WHEN 0 THEN 4 WHEN 1 THEN 18 WHEN 2 THEN 14 END AS document_code FROM part")
def symbol_kind_codes(t):
    kind = F.when(F.col("p_size") % 4 == 0, "Package").when(F.col("p_size") % 4 == 1, "Variable/Array").when(F.col("p_size") % 4 == 2, "Constant").otherwise("none")
    return t.part.select("p_partkey", kind.alias("kind")).join(F.broadcast(dimensions.dim_symbol_kind(t.spark)), "kind", "left").drop("kind")


@query("SELECT e.event_id, CASE e.event_type WHEN 'click' THEN ['ARRAY', 'LIST'] WHEN 'view' THEN ['EXPR'] END AS parameters, e.event_type IN ('click', 'view') AS is_builtin FROM events e")
def builtin_parameters(t):
    called = t.events.select("event_id", F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "view", "defined").otherwise(F.col("event_type")).alias("name"))
    return called.join(F.broadcast(dimensions.dim_builtin(t.spark)), "name", "left").select("event_id", "parameters", F.col("parameters").isNotNull().alias("is_builtin"))


@query("SELECT event_id, event_type = 'click' AS pragma, CASE event_type WHEN 'view' THEN ['getcwd', 'abs_path', 'realpath'] END AS exports FROM events")
def module_facts(t):
    used = t.events.select("event_id", F.when(F.col("event_type") == "click", "strict").when(F.col("event_type") == "view", "Cwd").when(F.col("event_type").isNotNull(), "Other").alias("module"))
    pragma = dimensions.dim_pragma(t.spark).withColumn("pragma", F.lit(True))
    # Rows of a list come from several tasks, in any order.
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "symbol"))), lambda x: x["symbol"])
    exports = dimensions.dim_known_export(t.spark).groupBy("module").agg(listed.alias("exports"))
    known = F.when(F.col("module").isNotNull(), F.coalesce("pragma", F.lit(False)))
    return used.join(F.broadcast(pragma), "module", "left").join(F.broadcast(exports), "module", "left").select("event_id", known.alias("pragma"), "exports")


@query("""SELECT conv_id, turn, role, text, CASE WHEN contains(m, 'class') OR contains(m, 'try') OR contains(m, 'catch') THEN 'ModernFeature' WHEN contains(m, 'string') OR contains(m, 'quote') OR contains(m, 'heredoc') OR contains(m, 'delimiter') OR role = 'user' THEN 'QuoteLike'
 WHEN contains(m, 'regex') OR contains(m, 'pattern') OR contains(m, 'substitution') THEN 'Regex' WHEN contains(m, 'given') OR contains(m, 'when') OR contains(m, 'switch') THEN 'ControlFlow' WHEN contains(m, 'dereference') OR contains(m, 'arrow') OR contains(m, '->') THEN 'Dereference'
 WHEN contains(m, 'signature') OR contains(m, 'prototype') OR contains(m, 'subroutine') THEN 'Subroutine' ELSE 'General' END AS category FROM (SELECT *, lower(text) AS m FROM conversations)""")
def error_categories(t):
    source = F.when(F.col("role") == "user", "print <<EOT").otherwise("print 1;")
    return t.conversations.select("conv_id", "turn", "role", "text", text.error_category(F.col("text"), source).alias("category"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'eval' WHEN 'view' THEN 'library' WHEN 'error' THEN 'core' ELSE 'user' END AS frame FROM events")
def frame_categories(t):
    path = F.when(F.col("event_type") == "click", "(eval 5)").when(F.col("event_type") == "view", "/usr/share/perl/site_perl/X.pm").when(F.col("event_type") == "error", "/usr/lib/perl5/strict.pm").otherwise("/home/me/x.pl")
    return t.events.select("event_id", text.frame_category(path, F.lit("main::f")).alias("frame"))


ERRORS = ["f(1);\nprint 'x;\n", "x;\n/abc\n", "y;\nmy $z = 1\n", "f(1;\n", "$a[1;\n", "if (1) {\n", "f(1);\n;", "f(1);\ng(2);\n"]


@query("SELECT event_id, ['UnclosedString', 'UnclosedRegex', 'MissingSemicolon', 'UnclosedParenthesis', 'UnclosedBracket', 'UnclosedBrace', 'UnexpectedEof', 'InvalidSyntax'][user_id % 8 + 1] AS kind FROM events")
def error_node_kinds(t):
    kind = (F.col("user_id") % 8).cast("int")
    place = F.get(F.array(*map(F.lit, (6, 3, 3, 0, 0, 0, 6, 0))), kind)
    return t.events.select("event_id", text.error_kind(F.get(F.array(*map(F.lit, ERRORS)), kind), place).alias("kind"))


# Arrays, maps and JSON


@query("SELECT p_type AS category, p_brand || '/' || p_partkey AS name, round(p_retailprice, 2) AS mean_ns FROM part")
def benchmark_reports(t):
    body = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.col("p_retailprice").alias("mean_ns")))).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.struct(F.col("p_retailprice").alias("nanoseconds")).alias("mean")))).otherwise(F.to_json(F.struct(F.struct(F.col("p_retailprice").alias("point_estimate")).alias("mean"))))
    report = F.concat(F.lit('{"'), "p_type", F.lit('": {"'), "p_brand", F.lit("/"), "p_partkey", F.lit('": '), body, F.lit("}}"))
    return nested.benchmark_rows(t.part.select(report.alias("text"))).withColumn("mean_ns", F.round("mean_ns", 2))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{"line":' || l_linenumber || ',"character":' || l_partkey || '}' AS position, l_linenumber AS line, l_partkey::INT AS character,
 '{"uri":"f' || l_orderkey || '","range":{"start":{"line":' || l_linenumber || ',"character":0},"end":{"line":' || l_linenumber || ',"character":' || l_partkey || '}}}' AS location FROM lineitem""")
def json_positions(t):
    position = nested.position_to_json(F.col("l_linenumber"), F.col("l_partkey"))
    back = nested.position_from_json(position)
    location = nested.location_to_json(F.concat(F.lit("f"), "l_orderkey"), F.col("l_linenumber"), F.lit(0), F.col("l_linenumber"), F.col("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", position.alias("position"), back["line"].alias("line"), back["character"].alias("character"), location.alias("location"))


@query("SELECT o_orderkey, 0 AS place, 'main::f' || o_custkey AS function, '1' AS arguments, 'lib/' || o_orderstatus || '.pm' AS path, (o_custkey % 1000)::INT AS line FROM orders UNION ALL SELECT o_orderkey, 2, 'main::run', '', 'run.pl', 7 FROM orders")
def stack_traces(t):
    output = F.concat(F.lit("$ = main::f"), "o_custkey", F.lit("(1) called from file 'lib/"), "o_orderstatus", F.lit(".pm' line "), F.col("o_custkey") % 1000, F.lit("\nnoise\n@ = main::run() called from file `run.pl' line 7"))
    return nested.stack_frames(t.orders.select("o_orderkey", output.alias("text")), ["o_orderkey"], "text")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END AS place, 2 AS n_children, (CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 4 ELSE 0 END)::INT AS bits FROM events")
def legend_places(t):
    names = F.array(F.when(F.col("value") > 50, "declaration"), F.when(F.col("user_id") % 2 == 0, "static"))
    bits = windows.modifier_bits(F.array_compact(names), ["declaration", "readonly", "static"])
    return t.events.select("event_id", F.try_element_at(nested.legend(["click", "view"]), F.col("event_type")).alias("place"), nested.child_count(names).alias("n_children"), bits.cast("int").alias("bits"))


@query("""SELECT o_orderkey, '$VAR1' AS name, '[' || o_custkey || ', "' || o_orderstatus || '", {"k": null}]' AS value, 'Array' AS shown FROM orders
 UNION ALL SELECT o_orderkey, '$VAR2', '{"class": "Order", "value": {"id": ' || o_orderkey || '}}', 'Order' FROM orders""")
def dumped_variables(t):
    dump = F.concat(F.lit("$VAR1 = ["), "o_custkey", F.lit(", '"), "o_orderstatus", F.lit("', {'k' => undef}];\n$VAR2 = bless( {'id' => "), "o_orderkey", F.lit("}, 'Order' );\n"))
    rows = t.orders.select("o_orderkey", dump.alias("_dump")).select("o_orderkey", F.explode(values.dump_variables("_dump")).alias("_v")).select("o_orderkey", "_v.*")
    return rows.select("*", values.shown_type(F.col("value")).alias("shown"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Scalar(Integer)' WHEN 1 THEN 'Scalar(Float)' WHEN 2 THEN 'Scalar(String)' WHEN 3 THEN 'Reference(Array)' WHEN 4 THEN 'Object(Shop::' || p_type || ')' ELSE 'Any' END AS type FROM part""")
def inferred_types(t):
    kind = F.col("p_size") % 6
    e = F.when(kind == 0, F.col("p_partkey").cast("string")).when(kind == 1, "1.5e3").when(kind == 2, F.concat(F.lit("'"), "p_name", F.lit("'"))).when(kind == 3, "[1, 2]").when(kind == 4, F.concat(F.lit("Shop::"), "p_type", F.lit("->new(1)"))).otherwise("f($x)")
    return t.part.select("p_partkey", e.alias("_e")).select("p_partkey", values.inferred_type("_e").alias("type"))


@query("SELECT user_id::VARCHAR AS uri, count(*)::INT AS n_symbols, count(DISTINCT event_type)::INT AS n_names, list_sort(list(DISTINCT event_type)) AS modules FROM events GROUP BY 1")
def nested_file_index(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("uri"), F.col("event_type").alias("name"), F.col("event_id").alias("sb"))
    index = nested.file_index(rows, rows, rows.select("uri", F.col("name").alias("module")))
    return index.select("uri", F.size("symbols").alias("n_symbols"), F.size("refs").alias("n_names"), "modules")

