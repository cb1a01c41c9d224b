"""Secret scans: patterns for the base kinds, and structural confirmation of encoded keys and signed tokens.

A first pass over a batch's bytes, without a loop in Python, finds the texts that can hold anything; patterns run on
those only. Confirmation decodes base64 and hexadecimal candidates and parses what they hold: DER with its nested
lengths, the fields of a private-key container, the headers of signed tokens.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bytestext import LOWER, buffers, steps

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt", "pem")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# Candidates for decoding: longest runs of the alphabets. Line ends may be escaped, as in JSON, and lines indented.
_EOL = r"(?:(?:[\r\n]|\\[rn])[\x20\t]*)+"
_B64 = re.compile(rf"(?:(?<![A-Za-z0-9+/\\])|(?<=\\[rn])|(?<=\\)(?![rn]))[A-Za-z0-9+/]{{40,}}(?:{_EOL}[A-Za-z0-9+/]+)*={{0,2}}")
_LINE_END = re.compile(_EOL)
_B64URL = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{40,}={0,2}")  # of one line, with a sign of its own
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY)-----")
_DEK = re.compile(r"([A-Z0-9-]{3,32}),([0-9A-Fa-f]{16,32})")
_OPENSSH = b"openssh-key-v1\0"
#: A key's sequences have ten items at most, and files of this format one key.
MOST_ITEMS, MOST_KEYS = 10, 16

_IN_HEX = np.zeros(256, bool)
_IN_HEX[[*b"0123456789abcdef"]] = True
_IN_B64 = np.zeros(256, bool)
_IN_B64[[*b"0123456789abcdefABCDEF"]] = True
_IN_B64[[*range(65, 91), *range(97, 123), *b"0123456789+/-_."]] = True
_WORDS = tuple(w.encode() for w in ("password", "passwd", "secret", "token", "apikey", "api_key", "akia", "-----begin "))


class Decoded:
    """The bytes of a base64 text, decoded where they are read: a header of a key is looked up, not its content."""

    def __init__(self, text: str, start: int = 0, chars: int | None = None):
        self.text, self.start = text, start
        self.chars = len(text) - start if chars is None else chars

    def __len__(self) -> int:
        return self.chars * 3 // 4

    def __getitem__(self, at: slice) -> bytes:
        lo, hi = max(at.start or 0, 0), min(len(self) if at.stop is None else at.stop, len(self))
        if hi <= lo:
            return b""
        first, last = lo // 3 * 4, min(-(-hi // 3) * 4, self.chars)
        some = self.text[self.start + first : self.start + last]
        raw = base64.b64decode(some + "=" * (-len(some) % 4))
        return raw[lo - first // 4 * 3 :][: hi - lo]


def _header(data, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the content) of the DER item at a place; None if it isn't one or doesn't end by ``end``."""
    head = data[at : min(at + 6, end)]
    if len(head) < 2 or head[0] & 0x1F == 0x1F:
        return None
    n, at = head[1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or len(head) < 2 + width:
            return None
        n, at = int.from_bytes(head[2 : 2 + width], "big"), at + width
        if n < 0x80 or n >> 8 * (width - 1) == 0:  # not the shortest form
            return None
    return (head[0], at, at + n) if at + n <= end else None


def der_items(data, start: int = 0, end: int | None = None, most: int = MOST_ITEMS) -> list[tuple[int, int, int]] | None:
    """(tag, start, end of the content) of each DER item; None unless the items, ``most`` at most, fill the range exactly."""
    end = len(data) if end is None else end
    out, at = [], start
    while at < end:
        item = _header(data, at, end) if len(out) < most else None
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def _key_items(data) -> list[tuple[int, int, int]] | None:
    """The items of the one sequence that the bytes are."""
    top = _header(data, 0, len(data))
    return der_items(data, *top[1:]) if top and top[0] == 0x30 and top[2] == len(data) else None


def _algorithm(data, items: list[tuple[int, int, int]]) -> bool:
    """Whether the first sequence among the items begins with an object identifier."""
    names = next((der_items(data, s, e) for t, s, e in items if t == 0x30), None)
    return bool(names) and names[0][0] == 0x06


def is_encrypted_key(data) -> bool:
    """Whether the bytes are one encrypted PKCS#8 key: an algorithm and what it encrypted."""
    items = _key_items(data)
    return bool(items) and [t for t, _, _ in items] == [0x30, 0x04] and items[1][2] > items[1][1] and _algorithm(data, items)


def is_der_key(data) -> bool:
    """Whether the bytes are one DER key: RSA (PKCS#1), EC (SEC1) or wrapped (PKCS#8, public or encrypted)."""
    items = _key_items(data)
    if not items:
        return False
    tags = [t for t, _, _ in items]
    if set(tags) == {0x02} and len(tags) in (2, 9, 10):  # modulus and exponents
        return max(e - s for _, s, e in items) >= 32
    if tags[:2] == [0x02, 0x04]:  # EC private key
        return items[0][2] - items[0][1] == 1 and items[1][2] - items[1][1] >= 16
    return (tags[:3] == [0x02, 0x30, 0x04] or tags in ([0x30, 0x03], [0x30, 0x04])) and _algorithm(data, items)


def der_length(data) -> int | None:
    """The length of the sequence that the bytes begin with, header included; None if they begin with none."""
    head = data[0:6]
    if len(head) < 2 or head[0] != 0x30:
        return None
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4 or len(head) < 2 + width or head[1] == 0x80:
        return None
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])


def openssh_length(data) -> int | None:
    """The length of the openssh-key-v1 file that the bytes begin with, by its own length fields; None if they begin with none.

    Length-prefixed cipher, kdf and options, a number of keys, as many public ones, and the private part.
    """
    if data[0:15] != _OPENSSH:
        return None
    at, left, keys = 15, 3, None
    while True:
        field = data[at : at + 4]
        if len(field) < 4:
            return None
        n, at = int.from_bytes(field, "big"), at + 4
        if not left and keys is None:
            if not 1 <= n <= MOST_KEYS:
                return None
            keys = left = n
            left += 1
            continue
        at, left = at + n, left - 1
        if at > len(data):
            return None
        if keys is not None and not left:
            return at


def is_openssh_key(data) -> bool:
    """Whether the bytes are one such file; blanks of its last base64 group aside."""
    n = openssh_length(data)
    return n is not None and n == len(data)


def _decoded(kind: str, s: str) -> bytes | None:
    try:
        if kind == "hex":
            return bytes.fromhex(s)
        if kind == "b64url":
            s = s.replace("-", "+").replace("_", "/")
        s = re.sub(r"\s", "", s).rstrip("=")
        return base64.b64decode(s[: len(s) - (len(s) % 4 == 1)] + "=" * (-len(s) % 4 % 3), validate=True)
    except (ValueError, binascii.Error):
        return None


def is_signed_token(head: str, body: str) -> bool:
    """Whether a header names an algorithm and the body is an object, both base64url of JSON."""
    try:
        h, b = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def _key_kind(data) -> str | None:
    if data and is_der_key(data):
        return "der"
    return "openssh" if data and is_openssh_key(data) else None


def _keys_of_lines(m: re.Match) -> list[tuple[str, int, int]]:
    """The keys among the lines of a base64 candidate.

    A key may begin at each line that is long enough, and ends where its own length fields say, if a line ends there:
    so it is told from lines of the alphabet before and after it. Fields are read where they are, a bounded number of
    them a line, so time is in proportion to the text.
    """
    whole = m[0].rstrip("=")
    lines, at = [], 0
    for e in _LINE_END.finditer(whole):
        lines.append((at, e.start()))
        at = e.end()
    lines.append((at, len(whole)))
    joined = "".join(whole[s:e] for s, e in lines)
    upto = np.cumsum([0, *[e - s for s, e in lines]])
    out, i = [], 0
    while i < len(lines):
        (start, end), found = lines[i], None
        if end - start >= 40:
            rest = Decoded(joined, int(upto[i]))
            for length in (der_length, openssh_length):
                if found or (size := length(rest)) is None:
                    continue
                chars = -(-4 * size // 3)
                j = int(np.searchsorted(upto, upto[i] + chars))
                if j < len(upto) and upto[j] == upto[i] + chars and (kind := _key_kind(Decoded(joined, int(upto[i]), chars))):
                    found = (kind, start, len(m[0]) if j == len(lines) else lines[j - 1][1], j)
        if found:
            out.append((found[0], m.start() + found[1], m.start() + found[2]))
        i = found[3] if found else i + 1
    return out


def _cipher_blocks(headers: dict[str, str], data: bytes) -> bool:
    """Whether headers name a cipher and its start, and the data is whole blocks of it."""
    dek = _DEK.fullmatch(headers.get("DEK-Info", ""))
    block = len(dek[2]) // 2 if dek else 0
    return headers.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED" and block in (8, 16) and len(data) > 0 and len(data) % block == 0


def _framed_key(label: str, body: str) -> bool:
    """Whether the lines between two marks are a key of the label's form."""
    lines = [x.strip() for x in body.replace("\\r", "\n").replace("\\n", "\n").splitlines()]
    headers = dict(x.split(":", 1) for x in lines if ":" in x)
    data = _decoded("b64", "".join(x for x in lines if ":" not in x))
    if not data:
        return False
    if "ENCRYPTED" in label:
        return is_encrypted_key(data)
    return is_der_key(data) or is_openssh_key(data) or _cipher_blocks({k: v.strip() for k, v in headers.items()}, data)


def _framed(text: str) -> list[tuple[str, int, int]]:
    """Keys between marks: each BEGIN with the next END of its label, if no other mark stands between."""
    out, begin = [], None
    for m in _MARK.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2] and _framed_key(m[2], text[begin.end() : m.start()]):
            out.append(("pem", begin.start(), m.end()))
        begin = m if m[1] == "BEGIN" else None
    return out


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), in code points, of encoded keys and signed tokens whose structure holds.

    Each kind goes over the text once, and no candidate is decoded more than once.
    """
    out = []
    for m in _JWT.finditer(text):
        if is_signed_token(m[1], m[2]):
            out.append(("jwt", *m.span()))
    out += _framed(text)
    for m in _B64.finditer(text):
        out += _keys_of_lines(m)
    for m in _B64URL.finditer(text):
        if kind := _key_kind(_decoded("b64url", m[0])):
            out.append((kind, *m.span()))
    for m in _HEX_ANY.finditer(text):
        if kind := _key_kind(_decoded("hex", m[0])):
            out.append((kind, *m.span()))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), in code points, of the base kinds."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind as listed, then end."""
    by = lambda x: (x[1], _ORDER[x[0]], x[2])
    base = sorted(base_spans(text), key=by)
    return base, sorted(base + confirmed(text), key=by)


def _runs(member: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """The rows with a run of ``least`` member bytes of their own: a run ends where its row does."""
    member = member.astype(np.int8)
    border = np.unique(offs[(offs > 0) & (offs < len(member))])
    first, last = np.diff(member, prepend=np.int8(0)) == 1, np.diff(member, append=np.int8(0)) == -1
    first[border] = member[border] == 1
    last[border - 1] = member[border - 1] == 1
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offs, start[end - start >= least], "right") - 1


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that can hold any span: those with a keyword or a long run of an alphabet."""
    rows = np.zeros(len(offs), bool)
    for member, least in ((_IN_HEX, 24), (_IN_B64, 24)):
        rows[_runs(member[data], offs, least)] = True
    low = LOWER[data].tobytes()
    for word in _WORDS:
        at = low.find(word)
        while at >= 0:
            row = int(np.searchsorted(offs, at, "right")) - 1
            rows[row] = True
            at = low.find(word, int(offs[row + 1]))
    return np.flatnonzero(rows[:-1])


_NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "t"):
        data, offs = buffers(b.column(1))
        n = b.num_rows
        counts = np.zeros((3, n), np.int64)
        digest, listed = [_NOTHING] * n, [""] * n
        for i in suspects(data, offs).tolist():
            base, every = spans_of(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
            for k, _, _ in base:
                counts[_ORDER[k], i] += 1
            digest[i] = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            listed[i] = ",".join(f"{k}:{s}:{e}" for k, s, e in every)
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts), pa.array(digest), pa.array(listed)], ["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row's whole text; null texts are empty.

    Narrow: no shuffle, one pass, memory of a few million bytes of text at a time (or of the longest text). Rows with
    no finding have zeros, the hash of nothing and an empty list.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_scan, f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("k", key)


def op10_secret_structure(spark, sf_dir: str) -> DataFrame:
    """A row a document: null texts are empty; repeated rows and null ids have their rows."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
