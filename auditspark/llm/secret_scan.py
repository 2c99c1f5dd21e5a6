"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

One automaton pass over the ASCII-lower-cased UTF-8 bytes finds the places where a keyword of any rule starts;
only there a rule's expression is matched, anchored at the keyword. Rules whose values embed a checksum keep a
match only if the checksum holds. Long hexadecimal runs have no keyword: a run of `HEX_MIN` digits covers a
position in every stride of that length, so strided probes find all of them without a scan of the whole text. A
private key's span covers the whole block, from the header over the body to the END line.

Cases: null and empty texts give no span; matches of one kind never overlap (leftmost first, and a match that
fails its length test still consumes its characters); several kinds may cover the same characters; texts are
always scanned whole; repeated rows give repeated results; an empty table gives an empty table; an input column
named like an output column is replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

HEX_MIN = 24
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = re.compile(rb"[0-9a-f]+")
_PROBE = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: keywords (lower case) at which `pattern` is matched, then `valid` decides."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: str


def _crc_tail(value: bytes) -> bool:
    """Prefixed access tokens: the last six characters are the base-62 CRC-32 of the characters after the prefix."""
    body = value[value.index(b"_") + 1 :]
    number, digits = zlib.crc32(body[:-6]), bytearray()
    while number:
        number, d = divmod(number, 62)
        digits.append(_BASE62[d])
    return bytes(reversed(digits)).rjust(6, b"0") == body[-6:]


def _checks(name: str, m: re.Match) -> bool:
    if name == "assign":
        return len(m[2]) >= 6
    if name == "access":
        return len(m[0]) >= 20
    if name == "crc":
        return _crc_tail(m[0])
    return True


#: What stands between the parts of a key block: white space, also escaped, and quotes or comment marks of code.
_BETWEEN = rb"""(?:\\[nrt]|//(?=\s)|[\s"'`,;>#|*\\])"""
#: A line's end, also escaped or at the end of a string of code, and what comments and quotations begin lines with.
_NEW_LINE = rb"""["'`,;+ \\]{0,4}(?:\r?\n|(?:\\r)?\\n(?:["'][ ,+\\]*\r?\n)?)(?://(?=\s)|[ \t"'`>#|*])*+"""
#: A key block reaches from its header to its END line. If none comes before the next dashes, it reaches over the PEM
#: fields, long runs of base64 digits and lines of nothing else that follow; a short run on the line of a long one
#: counts if it has a sign that words lack.
_KEYBLOCK = re.compile(
    rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:"
    rb"(?>(?:[^-]+|-(?!----))*)-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rb"|(?:%(between)s+(?:Proc-Type|DEK-Info|Comment|X-[A-Za-z0-9-]+):[^\r\n\\]*)*(?:"
    rb"%(between)s*+[A-Za-z0-9+/]{16,}+={0,2}"
    rb"|%(line)s[A-Za-z0-9+/]++={0,2}(?=[ \t\"'`,;]*(?:\r?\n|\\[rn]|$))"
    rb"|(?<=[A-Za-z0-9+/]{16})[ ](?=[A-Za-z+/]*[0-9+/=])[A-Za-z0-9+/]++={0,2}(?![A-Za-z0-9])"
    rb")*)" % {b"between": _BETWEEN, b"line": _NEW_LINE}
)

RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(
            rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        "assign",
    ),
    Rule("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), "access"),
    # Kinds beyond the base: values that carry a checksum of themselves, and key blocks.
    Rule("checked", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(rb"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), "crc"),
    Rule("keyblock", ("-----begin ",), _KEYBLOCK, "any"),
)
#: Order of kinds among spans that start at the same place.
KINDS = ("assign", "access", "hex", "checked", "keyblock")
BASE_KINDS = KINDS[:3]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, rule in enumerate(RULES):
        for k in rule.keywords:
            by.setdefault(k, []).append(i)
    for k, rules in by.items():
        a.add_word(k, (len(k), rules))
    a.make_automaton()
    return a


_PROBED = re.compile(rb"[0-9a-f]{%d,}" % (HEX_MIN // _PROBE))


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least HEX_MIN hexadecimal digits."""
    found, done = [], 0
    for m in _PROBED.finditer(data[::_PROBE]):
        # every probe of this group can belong to a run; runs do not extend past a failing probe
        at, end = max(done, (m.start() - 1) * _PROBE + 1, 0), m.end() * _PROBE
        for run in _HEX.finditer(data, at):
            if run.start() >= end:
                break
            if run.end() - run.start() >= HEX_MIN:
                found.append(run.span())
            done = max(done, run.end())
    return found


def scan(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, by start and then by kind."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    spans = [("hex", s, e) for s, e in _hex_runs(data)]
    free = [0] * len(RULES)
    for last, (length, rules) in automaton.iter(data.lower().decode("latin-1")):
        start = last - length + 1
        for i in rules:
            if start >= free[i] and (m := RULES[i].pattern.match(data, start)):
                free[i] = m.end()
                if _checks(RULES[i].valid, m):
                    spans.append((RULES[i].kind, start, m.end()))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    if len(data) == len(text) or not spans:
        return spans
    points, at, count = {}, 0, 0
    for p in sorted({p for s in spans for p in s[1:]}):
        count += len(data[at:p].decode("utf-8", "surrogatepass"))
        points[p], at = count, p
    return [(k, points[s], points[e]) for k, s, e in spans]


SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """docs with an array of (kind, start, end) spans; a map-only plan without a shuffle."""

    def make():
        automaton = _automaton()

        def apply(texts):
            return [[[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, automaton)] for t in texts]]

        return apply

    return append_columns(docs, text_col, make, [T.StructField(out_col, SPAN)])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every secret span (merged where they overlap) replaced by `mark`; all other text unchanged."""

    def make():
        automaton = _automaton()

        def clean(text):
            spans = scan(text, automaton)
            if not spans:
                return text
            out, at, reach = [], 0, 0
            for _, s, e in spans:
                if s >= reach:
                    out += [text[at:s], mark]
                reach = at = max(reach, e)
            return "".join(out) + text[at:]

        return lambda texts: [[clean(t) for t in texts]]

    name = "__redacted"
    done = append_columns(docs, text_col, make, [T.StructField(name, T.StringType())])
    return done.select(*[(F.col(name).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
