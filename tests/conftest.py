"""Shared fixtures: one local session for the whole run, checkpoints in a scratch dir."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from marktext.functions import chars as C  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


def marked(*parts) -> str:
    """Build text from pieces: ints are codepoints, strings pass through."""
    return "".join(chr(p) if isinstance(p, int) else p for p in parts)


# Letters and marks by codepoint (never typed as characters).
BA, TA, SIN, LAM, MIM, NUN, KAF, QAF = 0x0628, 0x062A, 0x0633, 0x0644, 0x0645, 0x0646, 0x0643, 0x0642
FATHA, DAMMA, KASRA, SUKUN, SHADDA, TANWIN_F, SUP_ALEF = 0x064E, 0x064F, 0x0650, 0x0652, 0x0651, 0x064B, 0x0670
ALEF_WASLA = 0x0671  # extended letter: counted, not mapped


def mini_sentences() -> list[str]:
    """F2-style corpus: ten marked sentences, our own words; one has kasra before shaddah."""
    w = {
        "kataba": marked(KAF, FATHA, TA, FATHA, BA, FATHA),
        "kutiba": marked(KAF, DAMMA, TA, KASRA, BA, FATHA),
        "kutub": marked(KAF, DAMMA, TA, DAMMA, BA, SUKUN),
        "salam": marked(SIN, FATHA, LAM, FATHA, MIM, TANWIN_F),
        "qalb": marked(QAF, FATHA, LAM, SUKUN, BA, DAMMA),
        "mudarris": marked(MIM, DAMMA, LAM, FATHA, NUN, SHADDA, KASRA),
        "kasra_shadda": marked(NUN, KASRA, SHADDA, MIM, FATHA),
        "sup": marked(LAM, SUP_ALEF, KAF, KASRA),
        "wasla": marked(ALEF_WASLA, FATHA, LAM, SUKUN),
        "lone": marked(FATHA, SHADDA),
    }
    return [
        f"{w['kataba']} {w['salam']}",
        f"{w['kutiba']} {w['qalb']}\n{w['kataba']}",
        f"  {w['kutub']}\t{w['mudarris']}  ",
        f"{w['kasra_shadda']} {w['sup']}",
        f"{w['wasla']} {w['kataba']} {w['lone']} {w['salam']}",
        f"{w['mudarris']}, {w['kutiba']}. 12 {w['qalb']}",
        f"{w['salam']} {w['salam']} {w['kutub']}",
        f"{w['kataba']}{w['kutiba']} {w['kutub']}",
        f"{w['sup']} {w['wasla']}\r\n{w['kasra_shadda']}",
        f"{w['qalb']} {w['mudarris']} {w['kataba']}",
    ]


def py_encode(text: str) -> str:
    """Brute-force T3: left to right, try 3, 2, 1 characters against the mapping."""
    m = C.atomic_mapping()
    out, i = [], 0
    while i < len(text):
        for n in (3, 2, 1):
            if text[i:i + n] in m and i + n <= len(text):
                out.append(m[text[i:i + n]])
                i += n
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    tmp = tempfile.mkdtemp(prefix="marktext-tests-")
    s = (SparkSession.builder.master("local[4]").appName("marktext-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", os.path.join(tmp, "ckpt"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from marktext.session import ensure_checkpoint_dir, ship_package
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="marktext-scratch-")


@pytest.fixture(scope="session")
def mini_corpus(spark):
    rows = []
    for rep in range(10):
        for j, t in enumerate(mini_sentences()):
            rows.append((rep * 10 + j, t, t.translate({ord(m): None for m in C.MARKS}), "ar", "mini"))
    return spark.createDataFrame(rows, "doc_id long, vocalized string, non_vocalized string, lang string, source string")
