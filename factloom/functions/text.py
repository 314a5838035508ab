"""Column functions over text: names, paths, positions, quotes, colours, codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dimensions


# Names


def sigil(name: Column) -> Column:
    """The sigil of a variable's name, or null."""
    return F.nullif(F.regexp_extract(name, r"^([$@%&])", 1), F.lit(""))


def bare_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^[$@%&]", "")


def variable_kind(sign: Column) -> Column:
    return F.when(sign == "@", "Array").when(sign == "%", "Hash").otherwise("Scalar")


def legacy_separator(name: Column) -> Column:
    """The old package separator, an apostrophe, as ::."""
    return F.replace(name, F.lit("'"), F.lit("::"))


def container_name(qualified: Column) -> Column:
    """What stands before the last ::, or null."""
    return F.nullif(F.regexp_extract(qualified, r"(?s)^(.*)::", 1), F.lit(""))


def last_name(qualified: Column) -> Column:
    return F.regexp_replace(qualified, r"(?s)^.*::", "")


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def can_rename(name: Column) -> Column:
    """Special variables and builtin functions keep their names."""
    return ~name.isin(dimensions.SPECIAL_VARIABLES + dimensions.FIXED_FUNCTIONS)


def module_of_path(path: Column) -> Column:
    """The module in a file: the path below the last /lib/, else the file's name, without .pm or .pl."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^(file://)+", ""), r"(\.pm)+$", ""), r"(\.pl)+$", "")
    below = F.regexp_extract(stem, r"^.*/lib/(.*)$", 1)
    return F.when(F.contains(stem, F.lit("/lib/")), F.replace(below, F.lit("/"), F.lit("::"))).otherwise(F.regexp_replace(stem, r"^.*/", ""))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def word_tokens(name: Column) -> Column:
    """Words of a camel-case, snake-case or qualified name, lower-cased."""
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^a-z0-9]+"), lambda t: t != "")


def names_of_list(argument: Column) -> Column:
    """Names in a quoted string or a qw list."""
    inside = F.regexp_extract(argument, r"^\s*(?:qw\s*[\(\[\{</|!]|['\"])(.*?)[\)\]\}>/|!'\"]\s*$", 1)
    return F.filter(F.split(F.trim(inside), r"\s+"), lambda t: t != "")


# Paths and URIs


def extension(path: Column) -> Column:
    """The extension of the last path segment, without query and fragment, or null."""
    last = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"[?#].*$", "")
    return F.nullif(F.regexp_extract(last, r"\.([^.]*)$", 1), F.lit(""))


def is_source_file(path: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("pl", "pm", "t", "psgi"), F.lit(False))


def is_skipped_folder(path: Column) -> Column:
    return path.rlike(r"(^|/)(\.git|\.hg|\.svn|target|node_modules|\.cache)/")


def uri_to_path(uri: Column) -> Column:
    """The path of a file URI, or null."""
    return F.when(F.startswith(uri, F.lit("file://")), F.url_decode(F.replace(F.regexp_extract(uri, r"^file://[^/]*(/.*)$", 1), F.lit("+"), F.lit("%2B"))))


def path_to_uri(path: Column) -> Column:
    """A file URI with every segment percent-encoded."""
    encode = lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), encode), "/"))


def uri_key(uri: Column) -> Column:
    """The URI with a drive letter in lower case."""
    drive = F.regexp_extract(uri, r"^file:///([A-Za-z]):", 1)
    return F.when(drive != "", F.concat(F.lit("file:///"), F.lower(drive), F.substring(uri, 10, 1 << 30))).otherwise(uri)


def is_file_uri(uri: Column) -> Column:
    return F.startswith(uri, F.lit("file://"))


def is_special_scheme(uri: Column) -> Column:
    """Whether the URI has a scheme other than file."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (scheme != "") & (scheme != "file")


def paths_match(stored: Column, seen: Column) -> Column:
    """Equal, or one is the end of the other."""
    return (stored == seen) | F.endswith(stored, seen) | F.endswith(seen, stored)


# Positions


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def utf16_width(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def position_of(text: Column, offset: Column) -> Column:
    """{line, column}, from zero, of a UTF-8 byte offset: columns count UTF-16 units, and an offset inside a character is its start."""
    bytes_before = F.call_function("left", F.encode(text, "UTF-8"), offset.cast("int"))
    # Bytes at the end that belong to a character that is not complete go: replacement characters stand for them.
    before = F.regexp_replace(F.call_function("make_valid_utf8", bytes_before.cast("string")), "\ufffd+$", "")
    last = F.element_at(F.split(before, "\n"), -1)
    return F.struct(newlines(before).alias("line"), utf16_width(last).alias("column"))


# Text scans


def line_matches(rows: DataFrame, key: list[str], column: str, pattern: str, group: int = 1) -> DataFrame:
    """(key, line, match): every match of a pattern on each line of a text, lines from 0."""
    lines = rows.select(*key, F.posexplode(F.split(column, "\n")).alias("line", "_line"))
    return lines.select(*key, "line", F.explode(F.regexp_extract_all("_line", F.lit(pattern), group)).alias("match"))


def line_spans(rows: DataFrame, key: list[str], column: str, pattern: str) -> DataFrame:
    """(key, line, start, match): like line_matches, with the character at which each whole match begins on its line."""
    # What stands before a match is the line's text between matches and the matches before it.
    lines = rows.select(*key, F.posexplode(F.split(column, "\n")).alias("line", "_line"))
    found = lines.select(*key, "line", F.split("_line", pattern, -1).alias("_between"), F.regexp_extract_all("_line", F.lit(f"({pattern})"), 1).alias("_matches"))
    at = F.transform("_matches", lambda m, i: F.struct((F.aggregate(F.slice("_between", 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("_matches", 1, i), F.lit(0), lambda n, x: n + F.length(x))).alias("start"), m.alias("match")))
    return found.select(*key, "line", F.explode(at).alias("_m")).select(*key, "line", "_m.*")


def in_comment(text: Column, position: Column) -> Column:
    """Whether a # stands before the position on its line."""
    before = F.call_function("left", text, position.cast("int"))
    return F.contains(F.element_at(F.split(before, "\n"), -1), F.lit("#"))


def in_string(text: Column, position: Column) -> Column:
    """Whether an odd number of single or of double quotes stands before the position."""
    before = F.call_function("left", text, position.cast("int"))
    odd = lambda q: (F.length(before) - F.length(F.replace(before, F.lit(q), F.lit("")))) % 2 == 1
    return odd("'") | odd('"')


def whole_word_count(text: Column, word: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"\b{word}\b")), F.lit(0))


def symbol_occurrences(text: Column, name: str, kind: str) -> Column:
    """Occurrences of a symbol in text by its kind: calls of a routine, uses of a package, any other word."""
    patterns = {"Subroutine": rf"\b{name}\s*\(|&{name}\b|->{name}\b", "Package": rf"\b{name}(?:->|::)|\b(?:use|require)\s+{name}\b"}
    return F.coalesce(F.regexp_count(text, F.lit(patterns.get(kind, rf"\b{name}\b"))), F.lit(0))


def node_types(sexp: Column) -> Column:
    return F.regexp_extract_all(sexp, F.lit(r"\(([A-Za-z_]\w*)"), 1)


def node_count(sexp: Column) -> Column:
    return F.length(sexp) - F.length(F.replace(sexp, F.lit("("), F.lit("")))


def normal_sexp(sexp: Column) -> Column:
    return F.trim(F.regexp_replace(sexp, r"\s+", " "))


def text_complexity(text: Column) -> Column:
    """{characters, emoji, beyond_latin}: counts by code point range."""
    emoji = F.regexp_count(text, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"))
    wide = F.regexp_count(text, F.lit(r"[\x{0250}-\x{10FFFF}]"))
    return F.struct(F.length(text).alias("characters"), emoji.alias("emoji"), wide.alias("beyond_latin"))


# Quotes and patterns


def regex_parts(literal: Column) -> Column:
    """{body, flags} of a pattern literal with a simple or paired delimiter."""
    pattern = r"(?s)^(?:qr|m)?\s*(?:/(.*)/|\{(.*)\}|\((.*)\)|\[(.*)\]|<(.*)>|([^\w\s])(.*)\6)([a-z]*)$"
    body = F.concat(*[F.regexp_extract(literal, pattern, i) for i in (1, 2, 3, 4, 5, 7)])
    return F.struct(body.alias("body"), F.regexp_extract(literal, pattern, 8).alias("flags"))


def substitution_parts(literal: Column) -> Column:
    """{pattern, replacement, flags} of s///, or of s{}{} and the like; escaped delimiters stay in their part."""
    one = r"(?s)^(?:s|tr|y)([^\w\s\{\(\[<])((?:\\.|(?!\1).)*)\1((?:\\.|(?!\1).)*)\1([a-z]*)$"
    two = r"(?s)^(?:s|tr|y)\s*[\{\(\[<]((?:\\.|[^\\])*?)[\}\)\]>]\s*[\{\(\[<]((?:\\.|[^\\])*?)[\}\)\]>]([a-z]*)$"
    simple = literal.rlike(one)
    part = lambda a, b: F.when(simple, F.regexp_extract(literal, one, a)).otherwise(F.regexp_extract(literal, two, b))
    return F.struct(part(2, 1).alias("pattern"), part(3, 2).alias("replacement"), part(4, 3).alias("flags"))


def valid_flags(flags: Column, allowed: str = "msixpodualngcer") -> Column:
    return flags.rlike(f"^[{allowed}]*$")


def runs_code(pattern: Column) -> Column:
    """Whether a pattern holds embedded code."""
    return pattern.rlike(r"(?<!\\)\(\?\??\{")


def nested_quantifiers(pattern: Column) -> Column:
    """Whether a quantified group ends in a quantifier itself."""
    return pattern.rlike(r"\((?:[^()\\]|\\.)*[+*}]\)[+*{]")


# Colours


def color_channels(hex_color: Column) -> Column:
    """{red, green, blue, alpha} from 0 to 1 of #rgb, #rrggbb or #rrggbbaa; null for anything else."""
    digits = F.regexp_extract(hex_color, r"^#?([0-9A-Fa-f]{8}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})$", 1)
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    channel = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255
    alpha = F.when(F.length(full) == 8, channel(7)).otherwise(F.lit(1.0))
    return F.when(digits != "", F.struct(channel(1).alias("red"), channel(3).alias("green"), channel(5).alias("blue"), alpha.alias("alpha")))


def hex_colors(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, line, start, color, length): hex colours in a text, from 0."""
    found = line_spans(rows, key, column, r"#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})\b")
    return found.select(*key, "line", "start", F.col("match").alias("color"), F.length("match").alias("length"))


def named_colors(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, line, start, name, color): names of colours that stand alone in quotes, whatever their case."""
    found = line_spans(rows, key, column, r"""["'][A-Za-z]+["']""")
    name = F.lower(F.expr("substring(match, 2, length(match) - 2)"))
    known = found.select(*key, "line", (F.col("start") + 1).alias("start"), name.alias("name"))
    return known.filter(F.col("name").isin(list(dimensions.NAMED_COLORS))).withColumn("color", lookup(F.col("name"), dimensions.NAMED_COLORS))


def ansi_colors(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, line, start, code): terminal colour sequences and the number of each one's last attribute."""
    found = line_spans(rows, key, column, r"\x1b\[[0-9;]*m")
    return found.select(*key, "line", "start", F.try_to_number(F.regexp_extract("match", r"(\d+)m$", 1), F.lit("999999")).cast("int").alias("code"))


def terminal_color(n: Column) -> Column:
    """{red, green, blue} of a colour of the 256-colour palette: 16 basic ones, a cube of six levels, 24 greys."""
    cube, grey = n - 16, 8 + 10 * (n - 232)
    strength = F.when(n < 8, 204).otherwise(255)
    basic = lambda bit: F.when(n == 8, 128).when(n.bitwiseAND(F.lit(bit)) != 0, strength).otherwise(0)
    pick = lambda bit, level: F.when(n < 16, basic(bit)).when(n < 232, level * 51).otherwise(grey) / 255.0
    return F.struct(pick(1, F.floor(cube / 36)).alias("red"), pick(2, F.floor(cube / 6) % 6).alias("green"), pick(4, cube % 6).alias("blue"))


def hsl(red: Column, green: Column, blue: Column) -> Column:
    """{hue in degrees, saturation and lightness in percent}, rounded."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    light, spread = (top + low) / 2, top - low
    saturation = F.when(spread == 0, 0.0).otherwise(spread / F.when(light > 0.5, 2 - top - low).otherwise(top + low))
    hue = F.when(spread == 0, 0.0).when(top == red, F.pmod((green - blue) / spread, F.lit(6.0))).when(top == green, (blue - red) / spread + 2).otherwise((red - green) / spread + 4) * 60
    return F.struct(F.round(hue).cast("int").alias("hue"), F.round(saturation * 100).cast("int").alias("saturation"), F.round(light * 100).cast("int").alias("lightness"))


# Codes and messages


def lookup(key: Column, table: dict) -> Column:
    """A value of a small fixed table, or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def code_of_message(message: Column) -> Column:
    """The diagnostic that a message speaks of: the first phrase found."""
    low = F.lower(message)
    out = F.lit(None).cast("string")
    for phrase, name in reversed(dimensions.MESSAGE_PHRASES):
        out = F.when(F.contains(low, F.lit(phrase)), name).otherwise(out)
    return out


def error_category(message: Column, source: Column) -> Column:
    """The category of a parse error by words of its message and of the whole source."""
    m, s = F.lower(message), F.lower(source)
    out = F.lit("General")
    for name, in_message, in_source in reversed(dimensions.ERROR_CATEGORIES):
        tests = [F.contains(m, F.lit(w)) for w in in_message] + [F.contains(s, F.lit(w)) for w in in_source]
        if name == "Regex":
            tests.append(F.contains(s, F.lit("s/")) & F.contains(s, F.lit("//")))
        if name == "Subroutine":
            tests.append(F.contains(s, F.lit("sub ")) & F.contains(s, F.lit("($")))
        out = F.when(reduce(lambda a, b: a | b, tests), name).otherwise(out)
    return out


def error_kind(source: Column, position: Column) -> Column:
    """What a parse error at a place of a source is: unbalanced quotes first, then the text at the place, then its line."""
    count = lambda of, c: F.length(of) - F.length(F.replace(of, F.lit(c), F.lit("")))
    at = F.substring(source, position + 1, F.lit(10))
    before, after = F.call_function("left", source, position), F.substring(source, position + 1, F.length(source))
    line = F.concat(F.element_at(F.split(before, "\n"), -1), F.element_at(F.split(after, "\n"), 1))
    bare = F.trim(line)
    quoted = lambda q: F.startswith(at, F.lit(q)) & ~F.endswith(at, F.lit(q))
    statement = reduce(lambda a, b: a | b, (F.contains(line, F.lit(w)) for w in ("my ", "our ", "local ", "print ", "say ", "return ")))
    open_ended = (bare != "") & ~F.substring(bare, -1, 1).isin(";", "{", "}")
    return (
        F.when((count(source, '"') % 2 == 1) | (count(source, "'") % 2 == 1) | quoted('"') | quoted("'"), "UnclosedString")
        .when(F.startswith(at, F.lit("/")) & (count(at, "/") == 1), "UnclosedRegex").when(open_ended & statement, "MissingSemicolon")
        .when(count(line, "(") > count(line, ")"), "UnclosedParenthesis").when(count(line, "[") > count(line, "]"), "UnclosedBracket").when(count(line, "{") > count(line, "}"), "UnclosedBrace")
        .when(position >= F.length(source) - 1, "UnexpectedEof").otherwise("InvalidSyntax")
    )


def display_time(nanoseconds: Column) -> Column:
    """Nanoseconds as text in the largest fitting unit."""
    return (
        F.when(nanoseconds < 1000, F.concat(nanoseconds.cast("long").cast("string"), F.lit("ns")))
        .when(nanoseconds < 1e6, F.format_string("%.1fus", nanoseconds / 1e3))
        .when(nanoseconds < 1e9, F.format_string("%.1fms", nanoseconds / 1e6))
        .otherwise(F.format_string("%.2fs", nanoseconds / 1e9))
    )


def frame_category(path: Column, function: Column) -> Column:
    """user, library, core or eval: of a stack frame by its path."""
    return F.when(F.startswith(path, F.lit("(eval")) | F.contains(function, F.lit("(eval)")), "eval").when(path.rlike(r"/(site_perl|vendor_perl|local/lib)/"), "library").when(path.rlike(r"/perl5?/|/lib/perl"), "core").otherwise("user")
