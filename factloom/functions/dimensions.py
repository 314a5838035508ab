"""Fixed tables: symbol kinds, diagnostic codes, pragmas, default exports, builtins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Symbol kinds and their protocol codes in workspace and document symbols.
SYMBOL_KINDS = [
    ("Package", 4, 4), ("Class", 5, 5), ("Role", 8, 8), ("Subroutine", 12, 12), ("Method", 6, 6), ("Variable/Scalar", 13, 13), ("Variable/Array", 13, 18),
    ("Variable/Hash", 13, 19), ("Constant", 14, 14), ("Import", 2, 2), ("Export", 12, 12), ("Label", 20, 20), ("Format", 23, 23),
]

# Diagnostic codes with name, severity, category.
DIAGNOSTIC_CODES = [
    ("PL001", "ParseError", "Error", "Parser"),
    ("PL002", "SyntaxError", "Error", "Parser"),
    ("PL003", "UnexpectedEof", "Error", "Parser"),
    ("PL100", "MissingStrict", "Warning", "StrictWarnings"),
    ("PL101", "MissingWarnings", "Warning", "StrictWarnings"),
    ("PL102", "UnusedVariable", "Warning", "StrictWarnings"),
    ("PL103", "UndefinedVariable", "Error", "StrictWarnings"),
    ("PL200", "MissingPackageDeclaration", "Warning", "PackageModule"),
    ("PL201", "DuplicatePackage", "Warning", "PackageModule"),
    ("PL300", "DuplicateSubroutine", "Warning", "Subroutine"),
    ("PL301", "MissingReturn", "Warning", "Subroutine"),
    ("PL400", "BarewordFilehandle", "Warning", "BestPractices"),
    ("PL401", "TwoArgOpen", "Warning", "BestPractices"),
    ("PL402", "ImplicitReturn", "Warning", "BestPractices"),
    ("PC001", "CriticSeverity1", "Warning", "PerlCritic"),
    ("PC002", "CriticSeverity2", "Warning", "PerlCritic"),
    ("PC003", "CriticSeverity3", "Hint", "PerlCritic"),
    ("PC004", "CriticSeverity4", "Hint", "PerlCritic"),
    ("PC005", "CriticSeverity5", "Hint", "PerlCritic"),
]

# Phrases that tell a diagnostic from its message, first match first.
MESSAGE_PHRASES = [
    ("use strict", "MissingStrict"), ("use warnings", "MissingWarnings"), ("unused variable", "UnusedVariable"), ("never used", "UnusedVariable"),
    ("undefined", "UndefinedVariable"), ("not declared", "UndefinedVariable"), ("bareword filehandle", "BarewordFilehandle"), ("two-argument", "TwoArgOpen"),
    ("2-arg", "TwoArgOpen"), ("parse error", "ParseError"), ("syntax error", "ParseError"),
]

# Phrases of message and source that tell the category of a parse error, first category first.
ERROR_CATEGORIES = [
    ("ModernFeature", ["class", "try", "catch"], ["class ", "field ", "method ", "try {", "try{", "catch ", "finally ", "builtin::"]),
    ("QuoteLike", ["string", "quote", "heredoc", "delimiter"], ["<<", "q{", "qq{", "qw{", "qx{"]),
    ("Regex", ["regex", "pattern", "substitution"], ["qr/", "qr{", "=~ /", "!~ /"]),
    ("ControlFlow", ["given", "when", "switch"], ["given ", "when ", "default "]),
    ("Dereference", ["dereference", "arrow", "->"], ["->@*", "->%*", "->$*"]),
    ("Subroutine", ["signature", "prototype", "subroutine"], []),
]

# Modules that change how a file is compiled.
PRAGMAS = [
    "strict", "warnings", "utf8", "bytes", "locale", "integer", "less", "sigtrap", "subs", "vars", "feature", "autodie", "autouse", "base", "parent", "lib", "bigint", "bignum", "bigrat",
]

# What common modules export by default.
KNOWN_EXPORTS = {
    "Data::Dumper": ["Dumper"],
    "JSON": ["encode_json", "decode_json", "to_json", "from_json"],
    "YAML": ["Load", "Dump", "LoadFile", "DumpFile"],
    "Storable": ["store", "retrieve", "freeze", "thaw"],
    "List::Util": ["first", "max", "min", "sum", "reduce", "shuffle", "uniq"],
    "Scalar::Util": ["blessed", "reftype", "looks_like_number", "weaken"],
    "File::Spec": ["catfile", "catdir", "splitpath", "splitdir"],
    "File::Basename": ["basename", "dirname", "fileparse"],
    "Cwd": ["getcwd", "abs_path", "realpath"],
    "Time::HiRes": ["time", "sleep", "usleep", "gettimeofday"],
    "Digest::MD5": ["md5", "md5_hex", "md5_base64"],
    "MIME::Base64": ["encode_base64", "decode_base64"],
    "URI::Escape": ["uri_escape", "uri_unescape"],
    "LWP::Simple": ["get", "head", "getprint", "getstore", "mirror"],
    "CGI": ["param", "header", "start_html", "end_html"],
}

# Builtin functions with their parameters, a documented part of the language's list.
BUILTINS = {
    "print": ["FILEHANDLE", "LIST"], "printf": ["FILEHANDLE", "FORMAT", "LIST"], "say": ["FILEHANDLE", "LIST"], "open": ["FILEHANDLE", "MODE", "FILENAME"],
    "close": ["FILEHANDLE"], "push": ["ARRAY", "LIST"], "pop": ["ARRAY"], "shift": ["ARRAY"], "unshift": ["ARRAY", "LIST"], "splice": ["ARRAY", "OFFSET", "LENGTH", "LIST"],
    "keys": ["HASH"], "values": ["HASH"], "each": ["HASH"], "exists": ["EXPR"], "delete": ["EXPR"], "defined": ["EXPR"], "undef": ["EXPR"],
    "map": ["BLOCK", "LIST"], "grep": ["BLOCK", "LIST"], "sort": ["BLOCK", "LIST"], "reverse": ["LIST"], "join": ["EXPR", "LIST"], "split": ["PATTERN", "EXPR", "LIMIT"],
    "substr": ["EXPR", "OFFSET", "LENGTH", "REPLACEMENT"], "index": ["STR", "SUBSTR", "POSITION"], "rindex": ["STR", "SUBSTR", "POSITION"], "length": ["EXPR"],
    "uc": ["EXPR"], "lc": ["EXPR"], "ucfirst": ["EXPR"], "lcfirst": ["EXPR"], "sprintf": ["FORMAT", "LIST"], "chomp": ["VARIABLE"], "chop": ["VARIABLE"],
    "abs": ["VALUE"], "int": ["EXPR"], "sqrt": ["EXPR"], "rand": ["EXPR"], "die": ["LIST"], "warn": ["LIST"], "eval": ["EXPR"], "ref": ["EXPR"], "bless": ["REF", "CLASSNAME"],
    "scalar": ["EXPR"], "wantarray": [], "time": [], "localtime": ["EXPR"], "require": ["EXPR"], "return": ["EXPR"], "exit": ["EXPR"],
}

# Modules that provide functions which are often called without an import.
GUESSED_MODULES = {"dumper": "Data::Dumper", "encode": "Encode", "decode": "Encode", "basename": "File::Basename", "dirname": "File::Basename", "mkpath": "File::Path", "rmtree": "File::Path", "slurp": "File::Slurp", "decode_json": "JSON", "encode_json": "JSON"}

# Names that a rename leaves alone.
SPECIAL_VARIABLES = ["_", ".", ",", "/", "\\", "!", "@", "$", "%", "0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "&", "`", "'", "+", "[", "]", "{", "}", "^O", "^V", "^W", "^X"]
FIXED_FUNCTIONS = [
    "print", "say", "printf", "sprintf", "open", "close", "read", "write", "push", "pop", "shift", "unshift", "map", "grep", "sort", "reverse", "split", "join",
    "chomp", "chop", "die", "warn", "eval", "exit", "require", "use", "package", "sub",
]

# Colour names with their values.
NAMED_COLORS = {"black": "#000000", "white": "#FFFFFF", "red": "#FF0000", "green": "#008000", "blue": "#0000FF", "yellow": "#FFFF00", "cyan": "#00FFFF", "magenta": "#FF00FF", "gray": "#808080", "orange": "#FFA500"}


def dim_symbol_kind(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOL_KINDS, "kind string, code int, document_code int")


def dim_diag_code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIAGNOSTIC_CODES, "code string, name string, severity string, category string")


def dim_known_export(spark: SparkSession) -> DataFrame:
    """The symbols that modules export, with their places in the lists, from 0."""
    return spark.createDataFrame([(m, s, i) for m, symbols in KNOWN_EXPORTS.items() for i, s in enumerate(symbols)], "module string, symbol string, position int")


def dim_builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUILTINS.items()), "name string, parameters array<string>")


def dim_pragma(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PRAGMAS], "module string")
