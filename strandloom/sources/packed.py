"""Packed references: two bits a base in blocks of equal length, and the text lines of their side files.

The packed bytes of all sequences, end to end, are cut at fixed places, so a block takes bounded memory whatever the sequences'
lengths and may span several of them. Unknown bases have no code: they are filled before, by writers.replace_unknown.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.sequence import BASES
from .bam import file_of

#: Bases of a block, a multiple of four.
BLOCK = 1 << 16
#: Fixed value: the seed named in the first line of annotations.
SEED = 11


def _spread(seqs: DataFrame, contigs: DataFrame, bases: int) -> DataFrame:
    """name, block, start (from 0, over all), seq of the part of each sequence in each block."""
    placed = seqs.select("name", "seq").join(contigs.where("len > 0").select("name", "offset", "len"), "name")
    end = F.col("offset") + F.col("len")
    rows = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / bases), F.floor((end - 1) / bases))))
    start = F.greatest("offset", F.col("block") * bases)
    stop = F.least(end, (F.col("block") + 1) * bases)
    return rows.select("name", "block", start.alias("start"), F.substring("seq", (start - F.col("offset") + 1).cast("int"), (stop - start).cast("int")).alias("seq"))


@F.pandas_udf(BinaryType())
def _pack(texts: pd.Series) -> pd.Series:
    codes = np.full(256, 255, np.uint8)
    codes[[ord(b) for b in BASES[:4]]] = range(4)

    def one(text: str) -> bytes:
        found = codes[np.frombuffer(text.encode(), np.uint8)]
        if (found == 255).any():
            raise ValueError("unknown bases can't be packed; fill them first")
        four = np.pad(found, (0, -len(found) % 4)).reshape(-1, 4)
        return (four @ np.array([64, 16, 4, 1])).astype(np.uint8).tobytes()

    return texts.map(one)


@F.pandas_udf(StringType())
def _unpack(packed: pd.Series) -> pd.Series:
    letters = np.array([[ord(BASES[b >> s & 3]) for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)
    return packed.map(lambda b: letters[np.frombuffer(b, np.uint8)].tobytes().decode())


def packed_blocks(seqs: DataFrame, contigs: DataFrame, bases: int = BLOCK) -> DataFrame:
    """block, packed: bytes of bases i*bases to (i+1)*bases of all sequences in the order of contigs; the first base in the highest bits.

    seqs: name, seq without unknown bases (an error else); contigs: name, offset, len. Empty sequences take no place; no rows give no blocks.
    """
    if bases < 4 or bases % 4:
        raise ValueError("a block has a multiple of four bases")
    pieces = _spread(seqs, contigs, bases).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))
    return pieces.select("block", _pack(F.array_join(F.transform("p", lambda x: x["seq"]), "")).alias("packed"))


def unpacked(blocks: DataFrame, contigs: DataFrame, bases: int = BLOCK) -> DataFrame:
    """name, seq of every contig (name, offset, len) of packed blocks, or of any stretch named by such a row."""
    end = F.col("offset") + F.col("len")
    wanted = contigs.where("len > 0").select("name", "offset", "len", F.explode(F.sequence(F.floor(F.col("offset") / bases), F.floor((end - 1) / bases))).alias("block"))
    start = F.greatest("offset", F.col("block") * bases)
    part = F.substring("text", (start - F.col("block") * bases + 1).cast("int"), (F.least(end, (F.col("block") + 1) * bases) - start).cast("int"))
    text = blocks.select("block", _unpack("packed").alias("text"))
    rows = wanted.join(text, "block").select("name", "offset", "block", part.alias("part")).groupBy("name", "offset").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p"))
    found = rows.select("name", "offset", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("seq"))
    return contigs.select("name", "offset").join(found, ["name", "offset"], "left").select("name", F.coalesce("seq", F.lit("")).alias("seq"))


def annotation_lines(contigs: DataFrame) -> DataFrame:
    """value: the lines of the annotation file: total bases, sequences and seed, then two lines a contig (name; offset, length, holes)."""
    head = contigs.agg(F.format_string(f"%d %d {SEED}", F.coalesce(F.sum("len"), F.lit(0)).cast("long"), F.count("*")).alias("value")).select(F.lit(-1).cast("long").alias("offset"), F.lit(-1).cast("long").alias("len"), "value")
    pairs = contigs.select("offset", F.col("len").cast("long").alias("len"), F.format_string("0 %s (null)\n%d %d %d", F.col("name").cast("string"), F.col("offset").cast("long"), F.col("len").cast("long"), F.col("n_ambs").cast("long")).alias("value"))
    return head.unionByName(pairs).orderBy("offset", "len").select("value")


def hole_lines(contigs: DataFrame, holes: DataFrame) -> DataFrame:
    """value: the lines of the file of holes: total bases, sequences and holes, then offset, length and letter of each."""
    total = contigs.agg(F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("bases"), F.count("*").alias("seqs")).crossJoin(holes.agg(F.count("*").alias("holes")))  # one row each
    head = total.select(F.lit(-1).cast("long").alias("offset"), F.format_string("%d %d %d", "bases", "seqs", "holes").alias("value"))
    rows = holes.select("offset", F.format_string("%d %d %s", F.col("offset").cast("long"), F.col("len").cast("long"), F.upper("base")).alias("value"))
    return head.unionByName(rows).orderBy("offset").select("value")


def write_pac(blocks: DataFrame, length: int, folder: str) -> DataFrame:
    """part, bytes: blocks written to the folder as files whose concatenation in the order of names is the packed file of length bases.

    The file ends with a byte 0 if its last base fills a byte, then the number of bases in the last byte. The folder must be one that
    all executors see. A part is written under a name of its own and renamed when whole, so a task that is run again does no harm.
    """
    tail = (b"\0" if length % 4 == 0 else b"") + bytes([length % 4])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = file_of(folder)
        where.create_dir(root)
        first, size, partial = None, 0, f"{root}/.{uuid.uuid4().hex}"
        with where.open_output_stream(partial) as out:
            for batch in batches:
                for block, packed in zip(batch["block"], batch["packed"], strict=True):
                    first = block if first is None else first
                    size += out.write(packed)
        if first is None:
            where.delete_file(partial)
            return
        where.move(partial, f"{root}/part-{first:012d}.pac")
        yield pd.DataFrame({"part": [first], "bytes": [size]})

    where, root = file_of(folder)
    where.create_dir(root)
    with where.open_output_stream(f"{root}/part-{10**12 - 1:012d}.pac") as out:
        out.write(tail)
    return blocks.repartitionByRange("block").sortWithinPartitions("block").mapInPandas(run, "part long, bytes long")
