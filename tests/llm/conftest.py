import pytest

#: Names that the operators use for columns of their own; in a caller's table they are ordinary columns.
CLASHING = ("count", "n", "key", "version", "score", "shard", "slot", "curve", "size", "blob", "found", "node", "tokens", "id", "label", "before", "total", "text_hash", "component")
DOCS = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASHING)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given (doc_id, text) rows, with further columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), *("x" for _ in CLASHING)) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def thue_morse(n):
    """Two words of n characters that sums of powers modulo 2**64 do not tell apart from 1,024 characters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="session")
def alike():
    return thue_morse(1024)
