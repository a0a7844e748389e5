"""Secret scan: fixed patterns, and strings that stay incompressible beside what surrounds them.

Base spans: the leftmost non-overlapping matches of each kind's pattern, without those that are too short.
Novelty: candidates are runs of LEAST or more key characters with a letter, and with a digit or letters of both cases, within NEAR characters
after a sensitive word or after a reported span that carries on from one (the lines of a key, the parts of a token); a candidate below NOVEL
doesn't carry on. zstandard, primed with a dictionary of code words and identifiers and with the text around the candidate, compresses that
text with it and with a run of one character in its place; the bytes it adds, against those that random text of its alphabet would need,
are its novelty. Spans of at least NOVEL that touch no base span are reported as the kind "novel".

The identifiers are the corpus's own: of all documents, the IDENTIFIERS names of several parts (snake_case or camelCase, at most LONG characters)
that most documents have, two at least, so that what occurs in one document can't excuse itself. That number bounds what is broadcast.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. Long texts are scanned whole, in time that grows with their
length. Spans of the same start come in the order of KINDS; identifiers of as many documents in that of their names. Rows that repeat give
the same spans. No documents: no rows. Columns besides doc_id and text are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the contract, their patterns, and the least length (of group 2 for assign, else of the match).
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "novel": 3}
#: Any text with a base span matches one of these, in the linear-time engine.
SCREEN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo]?[Rr]?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

#: Words that make what follows sensitive.
SENSITIVE = "password passwd passphrase secret token api_key apikey access_key private_key client_secret credential authorization bearer auth signature session_key encryption_key".split()
#: What code and settings are made of, for the dictionary.
CODE_WORDS = "import from return def class self function const let var public private static void string int bool true false null none export module require config settings environment production staging development localhost server client database connection user username email admin host port path http https request response headers content type application json authorization bearer basic session cookie access refresh key secret token password credential signature certificate".split()

LEAST, NEAR, NOVEL, AROUND = 16, 48, 0.8, 256
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
CONTEXT = re.compile("|".join(re.escape(w).replace("_", "[_ -]?") for w in sorted(SENSITIVE, key=lambda w: (-len(w), w))), re.IGNORECASE | re.ASCII)
CONTEXT_SCREEN = "(?i)" + "|".join(w.replace("_", "[_ -]?") for w in SENSITIVE)

#: Identifiers of the corpus in the dictionary, their shape and greatest length.
IDENTIFIERS, LONG = 4096, 64
IDENTIFIER = "[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+(?:[A-Z][a-z]+)+"


class Measure:
    """A compressor primed with code and identifiers, the most frequent last, where they are cheapest to refer to."""

    def __init__(self, identifiers: list[str]) -> None:
        code = "\n".join(f"{a} = {b}('{c}')" for a, b, c in zip(CODE_WORDS, CODE_WORDS[1:], CODE_WORDS[2:], strict=False))
        names = " ".join(f"{w} {w.upper()} {w}_id {w}_name get_{w} set_{w}" for w in [*CODE_WORDS, *SENSITIVE])
        held = f"{' '.join(reversed(identifiers))}\n{names}\n{code}\n"
        primed = zstandard.ZstdCompressionDict(held.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=12)
        self.compressor = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False)

    def size(self, data: bytes) -> int:
        return len(self.compressor.compress(data))

    def novelty(self, candidate: str, before: str, after: str) -> float:
        """Bytes that the candidate adds to its surroundings, as a share of its length at the entropy of its own alphabet; 1 at most."""
        around = f"{before} {after}".encode("utf-8", "surrogatepass")
        # Against a run of one character, so that what any further piece costs falls out.
        added = self.size(around + b" " + candidate.encode()) - self.size(around + b" " + candidate[:1].encode() * len(candidate))
        alphabet = 16 if re.fullmatch("[0-9a-fA-F]+", candidate) else 64
        return min(1.0, max(0.0, added / (len(candidate) * math.log2(alphabet) / 8)))


def identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> list[str]:
    """The corpus's identifiers by the number of documents that have them; at most so many reach the driver."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))
    counted = docs.select(F.explode(found).alias("name")).where(F.length("name") <= LONG).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counted.where("n > 1").orderBy(F.desc("n"), "name").limit(most).collect()]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS[x[2]]))


def keylike(candidate: str) -> bool:
    lower, upper, digit = (re.search(x, candidate) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    return bool((lower and upper) or (digit and (lower or upper)))


def next_candidate(text: str, at: int, near: int) -> re.Match | None:
    """The first candidate from a place on that begins not after another; what follows that place is looked at only to its end."""
    found = CANDIDATE.search(text, at, near + LEAST)
    return CANDIDATE.match(text, found.start()) if found else None


def novel_spans(text: str, base: list[tuple[int, int, str]], measure: Measure) -> list[tuple[int, int, str]]:
    out, at, k = [], -1, 0
    base = sorted(base)
    for word in CONTEXT.finditer(text):
        at, near = max(at, word.end()), word.end() + NEAR
        while m := next_candidate(text, at, near):
            at = m.end()
            while k < len(base) and base[k][1] <= m.start():
                k += 1
            if any(s < m.end() and m.start() < e for s, e, _ in base[k : k + 2 * len(KINDS)]):
                near = m.end() + NEAR
            elif keylike(m[0]) and measure.novelty(m[0], text[max(0, m.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND]) >= NOVEL:
                out.append((*m.span(), "novel"))
                near = m.end() + NEAR
    return out


def spans(text: str, measure: Measure | None, base: bool = True) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind; without a measure no novel ones."""
    own = base_spans(text) if base else []
    return own, sorted([*own, *(novel_spans(text, own, measure) if measure else [])], key=lambda x: (x[0], KINDS[x[2]]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


EMPTY = hashlib.sha256(b"").hexdigest()


def _scan(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = None
        for batch in batches:
            n = batch.num_rows
            texts = pc.fill_null(batch["text"], "")
            base = pc.match_substring_regex(texts, SCREEN)
            novel = pc.and_(pc.match_substring_regex(texts, CANDIDATE.pattern), pc.match_substring_regex(texts, CONTEXT_SCREEN))
            counts = {k: [0] * n for k in ("assign", "access", "hex")}
            digest, every = [EMPTY] * n, [""] * n
            for k in pc.indices_nonzero(pc.or_(base, novel)).to_pylist():
                if novel[k].as_py():
                    measure = measure or Measure(names)
                own, found = spans(texts[k].as_py(), measure if novel[k].as_py() else None, base[k].as_py())
                for *_, kind in own:
                    counts[kind][k] += 1
                digest[k], every[k] = hashlib.sha256(joined(own).encode()).hexdigest(), joined(found)
            told = [pa.array(v, pa.int64()) for v in counts.values()] + [pa.array(v, pa.string()) for v in (digest, every)]
            yield pa.record_batch([batch["doc_id"], *told], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. names: identifiers, if not the corpus's own."""
    run = _scan(identifiers(docs) if names is None else list(names))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
