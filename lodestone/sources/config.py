"""Configurations of archives: TOML, and lines of words."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone import schema as S
from lodestone.sources import files

#: White space between words, and the ends of lines.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
LINE_END = re.compile("\\r?\\n")
#: Fixed values of line configurations: keys that set a number, the option, its value if the word isn't a number.
NUMBERS = {
    "max_mem_usage": ("max_mem_usage", -1),
    "winsize": ("win_size", 16),
    "offsettablesize": ("offset_table_size", 8),
    "offsettables": ("offset_tables", 3),
    "offsetcontexts": ("offset_contexts", 3),
    "reflengthtablesize": ("ref_length_table_size", 7),
    "reflengthtables": ("ref_length_tables", 1),
    "refoffsettablesize": ("ref_offset_table_size", 7),
    "refoffsettables": ("ref_offset_tables", 3),
    "bigminmatch": ("big_min_match", 15),
}


def normal_path(text: str) -> str:
    """The same as functions.paths.resolve, for one path; raises where that gives null."""
    parts = [p for p in text.replace("\\", "/").split("/") if p not in ("", ".")]
    if any(p == ".." or ":" in p for p in parts):
        raise ValueError(f"refused path: {text!r}")
    return "/".join(parts) or "."


def _number(text: str, otherwise: int) -> int:
    low, high = (-(1 << 31), (1 << 31) - 1) if otherwise == -1 else (0, 255)
    digits = text[1:] if text[:1] == "+" or (text[:1] == "-" and low < 0) else text
    if not (digits.isascii() and digits.isdigit()):
        return otherwise
    return int(text) if low <= int(text) <= high else otherwise


def line_words(line: str) -> list[str]:
    """The words of a line; none of an empty line or a comment."""
    words = [w for w in SPACE.split(line) if w]
    return [] if words and words[0].startswith("#") else words


def file_entry(rest: list[str]) -> dict:
    """What a line `file path index method modifiers...` lists."""
    index, method = rest[1].removeprefix("+"), S.SPELLINGS.get(rest[2].lower())
    if not (index.isascii() and index.isdigit() and int(index) <= 0xFFFF):
        raise ValueError(f"not an archive index: {rest[1]!r}")
    if method is None:
        raise ValueError(f"not a compression method: {rest[2]!r}")
    return {"path": normal_path(rest[0]), "archive_file_index": int(index), "compression": method, "modifiers": " ".join(rest[3:])}


def parse_lines(text: str) -> dict:
    out = {"archives": [], "base_dir": ".", "files": [], "options": dict(S.OPTION_DEFAULTS)}
    for line in LINE_END.split(text):
        words = line_words(line)
        if not words:
            continue
        key, rest = words[0].lower(), words[1:]
        if key in NUMBERS and rest:
            option, otherwise = NUMBERS[key]
            out["options"][option] = _number(rest[0], otherwise)
        elif key == "file" and len(rest) >= 3:
            out["files"].append(file_entry(rest))
        elif key == "archive" and rest:
            out["archives"].append(rest[0])
        elif key == "basedir" and rest:
            out["base_dir"] = rest[0]
        elif key == "options" and rest:
            out["options"]["method"] = rest[0]
        elif key in ("use_combuf", "preprocess") and rest:
            out["options"][key] = rest[0] == "1"
    return out


def parse_toml(text: str) -> dict:
    raw = tomllib.loads(text)
    for key in ("archives", "base_dir", "files"):
        if key not in raw:
            raise ValueError(f"missing field `{key}`")
    entries = []
    for f in raw["files"]:
        if f["compression"] not in S.METHODS:
            raise ValueError(f"not a compression method: {f['compression']!r}")
        if not 0 <= f["archive_file_index"] <= 0xFFFF:
            raise ValueError(f"not an archive index: {f['archive_file_index']}")
        entries.append({"path": normal_path(f["path"]), "archive_file_index": f["archive_file_index"], "compression": f["compression"], "modifiers": f.get("modifiers", "")})
    options = raw.get("options")
    if options is not None and (missing := set(S.OPTION_DEFAULTS) - set(options)):
        raise ValueError(f"missing options: {', '.join(sorted(missing))}")
    return {"archives": raw["archives"], "base_dir": raw["base_dir"], "files": entries, "options": options and {k: options[k] for k in S.OPTION_DEFAULTS}}


def read_config(path: str) -> dict:
    """A configuration; the extension toml, spelled so, tells the format.  The base directory `.` is the configuration's own."""
    with files.open_file(path) as f:
        text = f.read().decode()
    config = parse_toml(text) if path.rpartition("/")[2].rpartition(".")[2] == "toml" and "." in path.rpartition("/")[2] else parse_lines(text)
    if config["base_dir"] == "." and "/" in path:
        config["base_dir"] = path.rpartition("/")[0] or "/"
    return config


def config_frame(spark: SparkSession, config: dict) -> DataFrame:
    """A configuration as a table of one row."""
    options = config["options"] and tuple(config["options"][k] for k in S.OPTION_DEFAULTS)
    entries = [tuple(f[c] for c in S.ENTRY.names) for f in config["files"]]
    return spark.createDataFrame([(config["archives"], config["base_dir"], entries, options)], S.CONFIG)


def _quoted(text: str) -> str:
    table = {'"': '\\"', "\\": "\\\\"} | {chr(k): f"\\u{k:04x}" for k in (*range(32), 127)}
    return '"' + "".join(table.get(c, c) for c in text) + '"'


def to_toml(config: dict) -> str:
    value = lambda v: _quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    out = [f"archives = [{', '.join(map(_quoted, config['archives']))}]", f"base_dir = {_quoted(config['base_dir'])}"]
    if not config["files"]:
        out.append("files = []")
    for f in config["files"]:
        out += ["", "[[files]]", *(f"{k} = {value(f[k])}" for k in S.ENTRY.names if f[k] != "" or k != "modifiers")]
    if config["options"]:
        out += ["", "[options]", *(f"{k} = {value(v)}" for k, v in config["options"].items())]
    return "\n".join(out) + "\n"


def parsed_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of configurations as rows, read as parse_lines() reads them: key, words after it, and for valid file lines
    path, archive_file_index, compression and modifiers.  Empty lines and comments go, as do nulls; other columns stay."""
    added = {"key": pa.string(), "rest": pa.string(), "path": pa.string(), "archive_file_index": pa.int32(), "compression": pa.string(), "modifiers": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [line_words(x or "") for x in b.column(line).to_pylist()]
            rows = []
            for w in filter(None, words):
                entry = {}
                if w[0].lower() == "file" and len(w) >= 4:
                    try:
                        entry = file_entry(w[1:])
                    except ValueError:
                        pass
                rows.append({"key": w[0].lower(), "rest": " ".join(w[1:])} | entry)
            kept = b.filter(pa.array([bool(w) for w in words], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r.get(k) for r in rows], t) for k, t in added.items())], names=[*b.schema.names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, f"{kinds}, key string, rest string, path string, archive_file_index int, compression string, modifiers string")
