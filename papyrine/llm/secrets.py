"""Secrets in texts: three exact patterns, and strings that a primed zstandard compressor finds new.

Base spans (kinds assign, access, hex) are the leftmost non-overlapping matches of each pattern that are long enough. The method
adds spans of kind `novel`: a candidate is a run of 16 or more key characters with a letter and a digit in whose surroundings (256
characters before, 128 after) there is a sensitive word (password, token, credential, ...), or that adjoins such a candidate with no
letter or digit between them, as the lines of a key do. The surroundings are compressed with and without it by
zstandard primed with a dictionary of code and identifiers; the extra bytes over its length tell how little the dictionary and
the surroundings explain of it. From `novelty` on it is reported, unless a base span overlaps it. In a private key block (BEGIN to END
line) with a candidate reported, all other lines of key characters alone are reported too, however short.

Offsets count code points, ends are exclusive. Edge cases: null and empty texts have no spans; very long texts are scanned whole;
spans of several kinds that start together stand in the order of the kinds; repeated rows and rows with a null doc_id stay, each
scanned; an empty table gives no rows; scan() doesn't use further columns of docs, redact() hands them on, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: [0-9a-f]+ of 16 or more: a shorter run holds no longer one, so the bound can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])(?=[0-9+/_=.-]*[A-Za-z])[A-Za-z0-9+/_=.-]{16,}")
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api[-_ ]?key|private[-_ ]?key|access[-_ ]?key|credential|auth|bearer|signature|session", re.I)
DIGIT = re.compile("[0-9]")
#: Code and identifiers that keys stand among; what resembles them compresses well.
DICTIONARY = b"""import os from typing return None self.config = settings.get("database_url") logger.info( def __init__(self, name: str, value: int = 0):
class ServiceClient: public static final String private void function const let var async await export default require module exports
client_id client_secret redirect_uri access_token refresh_token id_token token_type expires_in scope openid profile email api_key api_version
user_name username password passwd credential credentials authorization Authorization: Bearer Basic Content-Type: application/json charset=utf-8
http://localhost:8080/api/v1/users https://www.example.com/index.html?id=1&page=2 /usr/local/lib/python3/site-packages/ /etc/config/default.yaml
AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY AWS_REGION us-east-1 eu-west-1 DATABASE_URL REDIS_HOST SECRET_KEY PRIVATE_KEY PUBLIC_KEY SESSION_TOKEN
get_or_create update_all delete_by_id handler_function_name request_handler response_handler error_handler connection_pool max_retries timeout_seconds
2020-01-01T00:00:00Z 2024-12-31 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000
version_number_v1.0.0 release-candidate example_test_value placeholder_key_here your-token-here xxxxxxxxxxxxxxxx ----------------"""
BEFORE, AFTER = 256, 128
#: What may stand between adjoining candidates.
BETWEEN = re.compile("[^A-Za-z0-9]*")
BLOCK = re.compile("-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----((?:(?!-----BEGIN).)*?)-----END ", re.S)
LINE = re.compile(r"^[^\S\n]*([A-Za-z0-9+/_=.-]+)[^\S\n]*$", re.M)


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each byte of it."""
    size = _compressor().compress
    a, c, b = before.encode(), candidate.encode(), after.encode()
    return (len(size(a + c + b)) - len(size(a + b))) / len(c)


class Stretches:
    """Sorted spans, asked for overlaps by bisection."""

    def __init__(self, some: list[tuple[int, int, int]]):
        self.starts, self.reach = [a for a, _, _ in some], list(accumulate((b for _, _, b in some), max))

    def overlap(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.reach[k - 1] > a


def spans(text: str | None, threshold: float = 0.6) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if DIGIT.search(text):
        base = Stretches(sorted(found))
        reach = None  # the end of the last candidate in sensitive context
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if (reach is not None and BETWEEN.fullmatch(text, reach, a)) or SENSITIVE.search(text, max(0, a - BEFORE), a) or SENSITIVE.search(text, b, b + AFTER):
                reach = b
                if not base.overlap(a, b) and novelty(text[max(0, a - BEFORE) : a], m[0], text[b : b + AFTER]) >= threshold:
                    found.append((a, 3, b))
        if "PRIVATE KEY" in text:
            found.sort()
            starts = [a for a, _, _ in found]
            for block in BLOCK.finditer(text):
                own = found[bisect_left(starts, block.start(1)) : bisect_left(starts, block.end(1), hi=len(starts))]
                if any(k == 3 for _, k, _ in own):
                    taken = Stretches(own)
                    found += [(m.start(1), 3, m.end(1)) for m in LINE.finditer(text, *block.span(1)) if not taken.overlap(m.start(1), m.end(1))]
    return sorted(found)


def said(some: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in some)


def redacted(text: str, some: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, _, b in some:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans as text, and n_novel."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, base, every = [[], [], [], []], [], []
            for x in batch.column(1):
                some = spans(x.as_py(), threshold)
                for k, out in enumerate(n):
                    out.append(sum(s[1] == k for s in some))
                base.append(hashlib.sha256(said([s for s in some if s[1] < 3]).encode()).hexdigest())
                every.append(said(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(every, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, column: str = "text", threshold: float = 0.6, mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in column replaced; null texts stay null; all columns and rows stay."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        return texts.map(lambda x: None if x is None else redacted(x, s, mask) if (s := spans(x, threshold)) else x)

    return docs.withColumn(column, clean(F.col(column)))
