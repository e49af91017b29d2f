"""Secret scan: Aho-Corasick keywords, anchored expressions near hits, checksums that are part of the secret."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Least entropy, in bits a character, of the value of a generic assignment.
MIN_ENTROPY = 3.0


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base62_crc(value: str) -> str:
    """The CRC-32 of a text as six base-62 digits."""
    x, out = zlib.crc32(value.encode()), ""
    for _ in range(6):
        x, r = divmod(x, 62)
        out = _B62[r] + out
    return out


def _crc_token(value: str) -> bool:
    """Tokens like ghp_<30 characters><6 of checksum>."""
    body = value.split("_", 1)[1]
    return base62_crc(body[:-6]) == body[-6:]


def _unbase64(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def _jwt(value: str) -> bool:
    """Header and payload are JSON objects, the header with an algorithm."""
    try:
        head, body = (json.loads(_unbase64(x)) for x in value.split(".")[:2])
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(body, dict)


def _pem(value: str) -> bool:
    """The body is base64 and, if it isn't encrypted in the old way, a DER sequence of the length that it states, or OpenSSH's own form."""
    body = re.sub(r"-----[^-]*-----", "", value)
    if "Proc-Type:" in body:
        return True
    try:
        raw = base64.b64decode(re.sub(r"\s", "", body), validate=True)
    except (ValueError, binascii.Error):
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n], "big")


def _aws(value: str) -> bool:
    """A key id holds, in base 32, an account number of up to 12 digits."""
    try:
        raw = base64.b32decode(value[4:])
    except binascii.Error:
        return False
    account = (int.from_bytes(raw[:6], "big") & 0x7FFFFFFFFF80) >> 7
    return account < 10**12


def _generic(value: str) -> bool:
    return entropy(value) >= MIN_ENTROPY and any(c.isdigit() for c in value) and not re.fullmatch(r"[0-9.\-]+", value)


#: (kind, keywords in lower case, expression anchored at the keyword whose group s is the secret, test, whether the test is a checksum)
RULES = (
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9_])(?P<s>gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_token, True),
    ("npm", ("npm_",), r"(?<![A-Za-z0-9_])(?P<s>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_token, True),
    ("jwt", ("eyj",), r"(?<![A-Za-z0-9_\-.])(?P<s>eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,})(?![A-Za-z0-9_\-])", _jwt, True),
    ("private_key", ("-----begin",), r"(?P<s>-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]|-(?!----))*+-----END (?:[A-Z]+ )?PRIVATE KEY-----)", _pem, True),
    ("aws_key_id", ("akia", "asia"), r"(?<![A-Za-z0-9])(?P<s>A[KS]IA[A-Z2-7]{16})(?![A-Za-z0-9])", _aws, True),
    ("gitlab", ("glpat-",), r"(?<![A-Za-z0-9])(?P<s>glpat-[A-Za-z0-9_\-]{20})(?![A-Za-z0-9_\-])", None, False),
    ("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(?<![A-Za-z0-9])(?P<s>xox[baprs]-[0-9A-Za-z\-]{10,})(?![A-Za-z0-9\-])", None, False),
    ("stripe", ("sk_live_", "rk_live_"), r"(?<![A-Za-z0-9])(?P<s>[sr]k_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])", None, False),
    ("google", ("aiza",), r"(?<![A-Za-z0-9])(?P<s>AIza[A-Za-z0-9_\-]{35})(?![A-Za-z0-9_\-])", None, False),
    (
        "assignment",
        ("token", "secret", "passwd", "password", "api_key", "apikey", "api-key", "access_key", "auth_key", "private_key", "bearer"),
        r"(?i:token|secret|passwd|password|api_key|apikey|api-key|access_key|auth_key|private_key|bearer)[A-Za-z0-9_\-]{0,24}['\"]?(?:\s*(?:=>|:=|=|:)\s*|(?<=[Bb]earer)\s+)(?P<quote>['\"])?(?P<s>(?(quote)[^'\"\s]{16,}(?=(?P=quote))|(?!))|[A-Za-z0-9_\-./+=]{16,})",
        _generic,
        False,
    ),
)


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = [(kind, re.compile(expression), test, checked) for kind, _, expression, test, checked in RULES]
        words: dict[str, list[int]] = {}
        for number, rule in enumerate(RULES):
            for word in rule[1]:
                words.setdefault(word, []).append(number)
        self.keywords = ahocorasick.Automaton()
        for word, numbers in words.items():
            self.keywords.add_word(word, (len(word), tuple(numbers)))
        self.keywords.make_automaton()

    def scan(self, text: str, low: str) -> list[tuple[int, int, str, str, bool]]:
        """(start, end, kind, secret, whether a checksum proved it); low is text in lower case, of the same length."""
        found: dict[tuple[int, int], tuple[str, str, bool]] = {}
        # Where a rule's last match ends: a keyword inside of it begins no other one, and is passed in a step.
        until = [0] * len(self.rules)
        for last, (length, numbers) in self.keywords.iter(low):
            for number in numbers:
                kind, expression, test, checked = self.rules[number]
                if last + 1 - length < until[number]:
                    continue
                m = expression.match(text, last + 1 - length)
                if m and kind != "assignment":
                    until[number] = m.end()
                if m and (test is None or test(m["s"])):
                    span = m.span("s")
                    # One secret is reported once; a rule of its own goes before an assignment.
                    if span not in found or (kind != "assignment" and found[span][0] == "assignment"):
                        found[span] = kind, m["s"], checked
        inner = [x for x in found if found[x][0] != "assignment"]
        return [(a, b, *found[a, b]) for a, b in sorted(found) if found[a, b][0] != "assignment" or not any(p < b and a < q for p, q in inner)]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, kind, secret, checked) for each secret of each row, positions in characters.

    Keywords are found by one automaton over whole texts, in any case of
    ASCII letters; the expressions of a keyword's rules are tried only where
    it begins. Secrets with a checksum or a structure of their own (GitHub,
    npm, JWT, PEM, AWS key ids) are reported only if it holds, and are
    `checked`; values assigned to a telling name need 16 characters, some entropy and a
    digit; quoted ones go to the closing quote and have no white space, others
    consist of letters, digits and _-./+=.
    An assignment whose value holds a secret of another kind isn't reported
    again. Null and empty texts have none; repeated rows give repeated
    results, a null key a null. An empty table gives an empty result.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = d.select("key").schema.add("start", "long").add("end", "long").add("kind", "string").add("secret", "string").add("checked", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = batch.column(1)
            rows, out = [], []
            for r, low in enumerate(pc.ascii_lower(texts).to_pylist()):
                if low and next(scanner.keywords.iter(low), None) is not None:
                    for x in scanner.scan(texts[r].as_py(), low):
                        rows.append(r)
                        out.append(x)
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "start", "end", "kind", "secret", "checked"])

    return d.mapInArrow(run, schema).withColumnRenamed("key", key)
