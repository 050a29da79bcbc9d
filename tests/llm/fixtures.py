"""Small tables with the awkward rows every operator has to take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Deterministic text of n words with line breaks."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 8 & 15] + WORDS[x >> 13 & 15] + ("\n" if i % 17 == 16 else " "))
    return "".join(out)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids."""
    rows = [(i, prose(i, 60 + i % 50), ("en", "de", None)[i % 3], ("a", "b", None)[i % 4 % 3], 1) for i in range(40)]
    rows += [(100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \n\t ", None, None, 4), (None, prose(1, 70), "en", "b", 1), (103, "one", "en", "a", 3)]
    rows += [(104, prose(5, 30_000), "en", "a", 1), (105, "x" * 300_000, "en", "b", 1), (106, "+1 " * 20_000, "fr", "b", 1), (107, "naïve ÜBER 漢字 <|endoftext|>   \x1c tail", "zh", "c", 9)]
    rows += [rows[3]] * 5 + [(7, "another text of id seven", "en", "a", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns whose names operators use inside."""
    return df.withColumns({c: F.lit(c) for c in ("fp", "row", "ids", "chunk", "queue", "size", "skey", "h", "n", "n_words", "kept", "score", "spans", "component_id", "node", "y")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
