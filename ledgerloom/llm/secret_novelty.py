"""Secret scans by dictionary-primed zstandard novelty.

A candidate is a long run of token characters in a sensitive context: assigned to a name such as ``password``,
``api_key`` or ``accessToken``, after ``Bearer``, as the password in a URL, or with the prefix of an issuer of keys; or
the body of a PEM block of a private key.  What it adds to its surroundings is measured:
zstandard is primed with a dictionary of common identifiers and the text around the candidate (without the candidate
itself), and the bytes that compressing the candidate then takes are its marginal bytes.
A word that the tokenizer's vocabulary has takes two bytes at most, wherever it stands in the value.  Words, identifiers,
paths and placeholders are cheap after such a dictionary; a random string costs all that its alphabet holds.
The candidate is measured behind a carrier of known words, so that even a short one pays for its own bytes only and not
for the frame of a compressed block.  Candidates whose novelty (marginal bytes over the bytes that a random string of
their alphabet and length takes, as measured: long ones take less, and hexadecimal digits never more than half of their
length) reaches the limit are reported.

Defined results
---------------
* null or empty text: no findings; :func:`redact_secrets` returns it as it is;
* very long texts: scanned whole; only the surroundings of a candidate are bounded;
* null ids, repeated rows: every row is scanned and reported on its own;  ties: findings are in the order of the text;
* overlapping candidates: the one that starts first (the longer of two that start together);
* dates, times, UUIDs and the names of functions that are called are identifiers, not candidates; so are values of fewer
  than eight characters;
* long runs of any kind are read in linear time;  empty table: no findings;
* extra columns: not read; :func:`redact_secrets` returns its input's columns, with the text (and n_chars, if there is
  one) changed only where something was found.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ledgerloom.llm.bpe import VOCABULARY, load_ranks
from ledgerloom.llm.common import map_arrow

#: Share of a random string's marginal bytes, from which a candidate counts as incompressible.
NOVELTY = 0.85
#: Characters on either side that prime the dictionary.
AROUND = 1024
REDACTED = "[REDACTED]"

#: A sensitive name, wherever it stands in an identifier, and its sign of assignment, or an authorisation scheme.  What
#: follows the name in its identifier begins with a capital, a digit or a separator (secretKey, but not secretary).
ASSIGNED = re.compile(
    r"""(?i)(?:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth[_\-]?key|client[_\-]?secret|credential|signing[_\-]?key|encryption[_\-]?key|(?<![a-z])pass|(?-i:(?<=[a-z0-9])Pass))(?:key|value|id|hash|string)?s?(?:(?-i:[A-Z0-9_\-.])[a-z0-9_\-.]{0,256}+)?["'`]?\s*(?:=>|:=|==?|:)\s*["'`]?|(?<![a-z])(?:bearer|basic)\s+"""
)
#: The password in a URL's user information.
IN_URL = re.compile(r"""://[^\s/:@"'<>]{0,256}:([^\s/@"'<>]{8,})@""")
#: Where a PEM block begins and ends, and what a block without an end holds at least.
PEM = re.compile(r"-----(?:BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?)|BEGIN [A-Z0-9 ]{1,40}|END [A-Z0-9 ]{1,40})-----")
BASE64_LINES = re.compile(r"(?:[A-Za-z0-9+/=]|\\[rn]|\s)+")
ENCODED = re.compile(r"[A-Za-z0-9+/=]{16,}")
#: What may follow: a run of token characters, or after a quotation mark all up to the next one.
VALUE = re.compile(r"[A-Za-z0-9+/_\-.~!@#$%^&*]{8,}+=*+")
QUOTED = re.compile(r"""[^\s"'`]{8,}+(?=["'`])""")
#: Values that name a time or a thing.
PLAIN = re.compile(r"(?i)\d{2,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[T_]\d{1,2}[\d:.+\-]*Z?)?|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|v?\d+(?:\.\d+)+(?:[-+.][a-z0-9]{1,8})?")
#: Values of letters in runs; plain words ("the secret: understanding") are cheap by a dictionary of words.
LETTERS = re.compile(r"[A-Za-z]+(?:[-_./]+[A-Za-z]+)*")
RUN = re.compile(r"([A-Z]?[a-z]+|[A-Z]+)")
#: Issuers' prefixes stand for a context of their own.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{30,}|(?<![_\-])eyJ[A-Za-z0-9_\-]{16,}+\.[A-Za-z0-9_\-]{16,}+(?:\.[A-Za-z0-9_\-]+)?)"
)  # a web token starts where its run of characters does, so that each run is read once
HINT = re.compile(r"(?i)pass|pwd|secret|token|key|credential|bearer|basic|AKIA|ASIA|gh[pousr]_|github_pat|glpat|xox|[sr]k_|AIza|eyJ|://")

#: Identifiers and words that code and configuration are full of, and the usual placeholders.
IDENTIFIERS = " ".join(
    """password passwd passphrase secret token api_key apikey access_key private_key client_secret client_id username user
    example changeme change_me placeholder your_password your_token your_api_key insert_here redacted xxxxxxxxxxxxxxxx
    0000000000000000 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ null none true false
    undefined default config configuration settings environment environ getenv process.env os.environ System.getProperty
    request response session cookie header authorization authenticate authentication credential credentials encrypt
    decrypt encode decode base64 sha256 md5 hash generate random uuid string integer boolean function return import class
    public private static final void const let var def self this new object array list map dict key value name type index
    count length size file path directory folder http https www com org net localhost server client service database
    connection host port url uri endpoint test testing development production staging local remote master main branch
    version release update create delete insert select from where and or not the of to in is that for with""".split()
).encode()


#: What a candidate follows and what follows it when it is measured, each a single match with the dictionary.  The last
#: bytes of a block are never matched, so a candidate must not be there.
CARRIER, BEHIND = IDENTIFIERS[-200:] + b" ", b" " + IDENTIFIERS[:64]
HEXADECIMAL = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+")


#: Longest word that is looked for inside a run of letters, and the shortest whole run among other characters.
INSIDE, AMONG = 24, 4
#: Random strings are sampled up to this length; from there on their rate doesn't change.
SAMPLED = 1 << 15
#: A signed web token; its last part is the signature.
SIGNED = re.compile(r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.([A-Za-z0-9_\-]{16,})")


def alphabet(value: str) -> str:
    """The characters that a random string like value is made of: its digits' and letters' whole classes, its other marks."""
    if HEXADECIMAL.fullmatch(value):
        return "0123456789abcdef"
    classes = [c for c in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if not set(c).isdisjoint(value)]
    return "".join(classes + sorted(set(value) - set(string.digits + string.ascii_letters)))


_WORDS: dict[str, frozenset[str]] = {}


def known_words(path: str = VOCABULARY) -> frozenset[str]:
    """The words of the tokenizer's vocabulary in lower case, read once for each process."""
    if path not in _WORDS:
        tokens = (t.decode("utf-8", "replace").strip() for t in load_ranks(path))
        _WORDS[path] = frozenset(t.lower() for t in tokens if len(t) > 1 and t.isascii() and t.isalpha())
    return _WORDS[path]


class Novelty:
    """Marginal compressed bytes of candidates, as a share of those of random strings."""

    def __init__(self, path: str = VOCABULARY):
        self.path = path
        self.params = zstandard.ZstdCompressionParameters.from_level(15, window_log=14, hash_log=12, chain_log=12, min_match=3, write_content_size=False, write_dict_id=False)
        self.random: dict[tuple[str, int], float] = {}

    def marginal(self, data: bytes, primed: bytes) -> int:
        compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=self.params).compress
        return max(0, len(compress(CARRIER + data + BEHIND)) - len(compress(CARRIER + BEHIND)))

    def of_random(self, value: str, size: int) -> float:
        """Bytes for each byte that a random string of the value's alphabet takes.

        Literals of long strings are Huffman-coded, so it falls with the length.  The least of some strings of twice the
        length up to the next power of two is taken: no random value comes much below.
        """
        key = alphabet(value), min(SAMPLED, 2 << max(3, (size - 1).bit_length()))
        if key not in self.random:
            if len(self.random) >= 4096:
                self.random.clear()
            draw = random.Random(repr(key))
            samples = ("".join(draw.choices(key[0], k=key[1])).encode("utf-8", "surrogatepass") for _ in range(4))
            self.random[key] = min(1.0, *(self.marginal(x, IDENTIFIERS) / len(x) for x in samples))
            if HEXADECIMAL.fullmatch(value):
                self.random[key] = min(0.5, self.random[key])
        return self.random[key]

    def __call__(self, text: str, lo: int, hi: int) -> float:
        """Of text[lo:hi], against what is around it; repetitions of it don't count as surroundings, at the edge neither.

        A signed token is as novel as its signature, whatever its readable parts repeat.
        """
        value, reach = text[lo:hi], AROUND + hi - lo
        around = text[max(0, lo - reach) : lo].replace(value, " ")[-AROUND:] + " " + text[hi : hi + reach].replace(value, " ")[:AROUND]
        primed = IDENTIFIERS + b" " + around.encode("utf-8", "surrogatepass")
        signed = SIGNED.fullmatch(value)
        return max(self.share(x, primed) for x in ((value, signed[1]) if signed else (value,)))

    def share(self, value: str, primed: bytes) -> float:
        """Marginal bytes over those of a random string, with the value as it stands and with its words shortened."""
        data = value.encode("utf-8", "surrogatepass")
        whole = len(data) * self.of_random(value, len(data))
        least = self.marginal(data, primed)
        if least >= NOVELTY * whole:
            least = min(least, self.marginal(self.shortened(value), primed))
        return min(1.0, least / whole)

    def shortened(self, value: str) -> bytes:
        """The value with two bytes, a place in a dictionary, for each word in it and a separator after it.

        Whole runs of letters count (among other characters those of four letters and more), and inside a run words of
        five letters and more, which random letters hardly contain.
        """
        words = known_words(self.path)
        shortest = 1 if LETTERS.fullmatch(value) else AMONG

        def of_word(word: str) -> bytes:
            return bytes(128 | x for x in zlib.crc32(word.encode()).to_bytes(4)[:2])

        def of_run(run: str) -> bytes:
            low, out, at = run.lower(), bytearray(), 0
            if len(low) >= shortest and low in words:
                return of_word(low)
            while at < len(low):
                size = next((n for n in range(min(INSIDE, len(low) - at), 4, -1) if low[at : at + n] in words), 0)
                out += of_word(low[at : at + size]) if size else run[at].encode()
                at += size or 1
            return bytes(out)

        parts = RUN.split(value)  # what is between runs, and the runs, in turn
        out = b"".join(of_run(x) if k % 2 else x.encode("utf-8", "surrogatepass") for k, x in enumerate(parts))
        return re.sub(rb"([\x80-\xff])[-_./]", rb"\1", out) if shortest == 1 else out


def pem_bodies(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands in blocks of private keys; a block that is cut off goes as far as its base64 lines."""
    marks, out = list(PEM.finditer(text)), []
    for m, following in zip(marks, [*marks[1:], None]):
        if m[1]:
            lo, hi = m.end(), following.start() if following else len(text)
            if not following or not following[0].startswith("-----END"):
                run = BASE64_LINES.match(text, lo, hi)
                hi = run.end() if run else lo
            body = text[lo:hi]
            if ENCODED.search(body):
                lo += len(body) - len(body.lstrip())
                out.append((lo, lo + len(body.strip())))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every candidate, in order, without overlaps."""
    found = []
    for m in ASSIGNED.finditer(text):
        at = m.end()
        v = (text[at - 1] in "\"'`" and QUOTED.match(text, at)) or VALUE.match(text, at)
        if not v or text.startswith("(", v.end()):  # the name of a function that is called
            continue
        end = v.end() - (len(v[0]) - len(v[0].rstrip(".!*")))  # closing marks belong to the sentence
        if end - at < 8:
            end = v.end()
        if not PLAIN.fullmatch(text, at, end):
            found.append((at, end, "assigned"))
    found += [(*m.span(1), "url") for m in IN_URL.finditer(text)]
    found += [(lo, hi, "pem") for lo, hi in pem_bodies(text)]
    found += [(m.start(), m.end(), "issued") for m in ISSUED.finditer(text)]
    out, last = [], 0
    for lo, hi, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if lo >= last:
            out.append((lo, hi, kind))
            last = hi
    return out


def findings(text: str | None, novelty: Novelty, limit: float = NOVELTY) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, novelty) of the secrets in a text."""
    if not text or not HINT.search(text):
        return []
    scored = ((lo, hi, kind, novelty(text, lo, hi)) for lo, hi, kind in candidates(text))
    return [x for x in scored if x[3] >= limit]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = NOVELTY) -> DataFrame:
    """(doc_id, kind, begins, ends, novelty, masked) of every secret; places count characters.  Map-side only.

    The value itself is never returned, only its first four characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            rows = [(i, kind, lo, hi, n, t[lo : lo + 4] + "…") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for lo, hi, kind, n in findings(t, novelty, limit)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "kind", "begins", "ends", "novelty", "masked"])

    return map_arrow(df.select(id_col, text_col), run, "doc_id bigint, kind string, begins bigint, ends bigint, novelty double, masked string")


def redact(text: str, found: list[tuple[int, int, str, float]]) -> str:
    out, last = [], 0
    for lo, hi, _, _ in found:
        out += [text[last:lo], REDACTED]
        last = hi
    return "".join(out) + text[last:]


def redact_secrets(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", limit: float = NOVELTY) -> DataFrame:
    """df with its secrets replaced; the number of characters follows where the column is there."""
    at = df.columns.index(text_col)
    count_at = df.columns.index(chars_col) if chars_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [findings(t, novelty, limit) for t in texts]
            if not any(found):
                yield b
                continue
            columns = list(b.columns)
            new = [redact(t, f) if f else t for t, f in zip(texts, found)]
            columns[at] = pa.array(new, b.column(at).type)
            if count_at is not None:
                old = b.column(count_at)
                columns[count_at] = pa.array([len(t) if f else n for t, f, n in zip(new, found, old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_arrow(df, run, df.schema)
