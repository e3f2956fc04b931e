"""Archive analytics on Spark: binary archives and their processing steps as tables and DataFrame operators."""

from lodestone.plans.archives import contents, open_archives, pack, pack_frame, pack_frames, unpack, verify
from lodestone.schema import ArchiveError
from lodestone.sources.archive import table
from lodestone.sources.config import parse_lines, parse_toml, read_config
from lodestone.sources.header import Header, parse, serialise


def set_verbosity(spark, verbose: bool = False) -> None:
    """The level of the log: what goes on, or everything."""
    spark.sparkContext.setLogLevel("DEBUG" if verbose else "INFO")


__all__ = ["ArchiveError", "Header", "contents", "open_archives", "pack", "pack_frame", "pack_frames", "parse", "parse_lines", "parse_toml", "read_config", "serialise", "set_verbosity", "table", "unpack", "verify"]
