"""Small frames that hold every odd case."""

import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _id long, kept string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """A documents table with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", 0, 9.0, 7, "x") for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ODD = [
    (1, "The same  text\n", "en"), (2, "Thesame text", "en"), (2, "Thesame text", "en"), (3, None, "en"),
    (4, "", None), (None, "The same text", "de"), (5, " \t\x0b ", "en"), (6, "ein anderer Text, ß ü 😀", "de"),
    (7, "word " * 3000, "en"), (8, "x" * 20000, None), (None, None, None), (9, "été <|endoftext|> été", "fr"),
]


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus
