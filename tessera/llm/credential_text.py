"""Where in one text a credential may stand: names, forms and places of literals. Used inside tasks by ``tessera.llm.credentials``."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

# Forms that issuers give their keys and tokens.
ISSUED = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"AIza[A-Za-z0-9_\-]{35}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{40,}",
    r"glpat-[A-Za-z0-9_\-]{20}",
    r"xox[abeoprs]-[A-Za-z0-9\-]{20,}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_\-]{50,}",
    r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"whsec_[A-Za-z0-9]{24,}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{32,}",
    r"pat_[0-9a-f]{40}",
    r"dop_v1_[0-9a-f]{64}",
    r"hf_[A-Za-z0-9]{34}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{20,}",
)
# What the last word of a telling name is, and the words that make "key" telling.
KEY_OF = "api|access|secret|signing|encryption|hmac|licen[cs]e|account|private|client|master|auth|shared|service|ssh|deploy|storage|session|webhook|crypto|aes|jwt|root|admin|user|app|db"
TELLING = rf"(?:pass(?:words?|wd|wor[dt]|phrase|code)?|pwd|pw|secrets?|token|credentials?|kennwort|(?:{KEY_OF})[_\-. ]?key)"
NAME = rf"[A-Za-z0-9_\-.]*?{TELLING}"
# The words with which placeholders begin, and those that may follow; a value that goes on otherwise is left to the count of its owners.
FIRST = "change|replace|fill|enter|put|set|insert|add|your|my|example|sample|dummy|fake|placeholder|redacted|removed|hidden|todo|tbd|fixme|none|null|nil|true|false|auto|undefined|default|empty|secret|password|passwd|token|changeit"
WORDS = FIRST + (
    "|our|the|an|pass|pwd|passphrase|secrets|me|this|here|it|in|with|by|for|to|from|of|is|not|no|be|at|real|actual|some|any|new|value|string|text|key|keys|api|access|auth|client|user|username|admin|root|login|account|service"
    "|db|database|app|private|public|credential|credentials|prod|production|dev|test|local|env|vault|later|before|deploy|use|goes|x++"
)
PLACEHOLDER = re.compile(
    rf"""(?xi) ^\s*$ | ^(.)\1*$ | ^[*x.\-_#]+$ | ^0+$
    | ^(?:{FIRST})(?=$|[_\-. ]|me|this|here)(?:[_\-. ]*(?:{WORDS}|\d{{1,3}}(?!\d)))*[!._\-]*$
    | [_\-. ]here$ | ^<[^<>]*>$ | ^%[^%]*%$ | \$\{{[^}}]*\}} | \{{\{{.*\}}\}} | ^\$[A-Za-z_(] | ^\#\{{ | ^@[A-Za-z.]+\( | ^%\( | ^\[[^\]]*\]$
    | ^(?:vault|env|ssm|secretsmanager|arn|op|file|keyring|kms|ref|secretref|azurekv|gcp|sops|pass|bw)[:/] | (?:getenv|environ|process\.env|env!|ENV\.|ENV\[|Environment\.) | ^[a-z_]+(?:\.[a-z_]+)*\([^)]*\)?$ | EXAMPLE$
    """
)
CERTAIN = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(ISSUED) + ")")
QUOTED = r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)"""
NAMED = re.compile(rf"""(?i){TELLING}(?![A-Za-z0-9])["'\]]*(?:\s*:\s*&?[A-Za-z]+(?=\s*=)|\s*\{{\s*get;\s*set;\s*\}})?\s*(?:=>|:=|=|:|,)\s*(?:{QUOTED}|([^\s"'`<>;,()\[\]{{}}]+(?=$|[\s;,<'")])))""")
SPACED = re.compile(rf"""(?i)(?:^|\s)(?:\#define\s+{NAME}\s+{QUOTED}|ENV\s+{NAME}\s+(\S+)|(?:^\s*|login\s+\S+\s+)(?:password|passwd|pw)\s+([^\s"'=:]+)\s*$)""")
ATTRIBUTE = re.compile(rf"""(?i)(?:key|name|id)\s*=\s*["']{NAME}["']\s+(?:value|content)\s*=\s*{QUOTED}""")
ELEMENT = re.compile(rf"(?i)<({NAME})(?:\s[^<>]*)?>([^<>\s]+)</")
HEADER = re.compile(r"""(?i)(?:\bBearer\s+|X-[A-Za-z\-]*(?:Key|Token):\s*|Authorization:\s*token\s+)([A-Za-z0-9+/=_.~\-]{12,})""")
BASIC = re.compile(r"\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})")
ADDRESS = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@"'<>]*:([^\s/@"'<>]+)@""")
CONNECTION = re.compile(r"""(?i)[;?&](?:password|pwd)=([^\s;&"'<>]+)""")
SPOKEN = re.compile(
    r"""(?xi) (?:password|passwort|passwd|passphrase|pw|pwd|secret|token|api[ ]key)\s+(?:is|was|ist|lautet|=)\s+(\S+) | passphrase\s+(\S+) | \blogin\s+\S+\s+/\s+(\S+) | \buse\s+(\S+)\s+for\s+user\b | --?(?:password|passwd|pass|pw|token|secret|api-key)[= ](\S+)
    | sshpass\s+-p\s*(\S+) | curl\s[^\n]*?-u\s+["']?[^\s:"']+:([^\s"']+) | \bidentified\s+by\s+(\S+) | \bmysql\b[^\n]*\s-p(\S+) | (?:密码|口令|密钥)\s*(?:是|为|：|:)\s*(\S+)"""
)
BELOW = re.compile(rf"""(?i)({TELLING})["'\]]*\s*(?:\s*:\s*&?[A-Za-z]+(?=\s*=))?(?:=>|:=|=|:)\s*(?:\(|[>|][+-]?|\\|\"\"\"|'''|`)?\s*$|{TELLING}\s*<<[-~]?\s*["']?\w+["']?\s*$|<({NAME})(?:\s[^<>]*)?>\s*$""")
LONE = re.compile(rf"""^\s*(?:{QUOTED}[,;)]*|([^\s"'`<>(){{}}\[\],;]+))\s*\\?$""")
BEGIN_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
BODY = re.compile(r"[A-Za-z0-9+/]{40,}")
END_KEY = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
AROUND = re.compile(r"""^[\s"'`+#/*;]+(?=[A-Za-z0-9+/\s]|$)|[\s"'`+;,\\]+$""")
KEY_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9\-]*:(?:\s|$)")
JOINED = re.compile(r"""(["'])\s*(?:\+|\.{1,2}|&|~|<>|\|\|)?\s*\1""")
HASHED = re.compile(r"(?i)^(?:sha\d*[-:]|fp:|md5:)")
LIKELY = re.compile(r"(?i)pass|pwd|pw|secret|token|key|credential|kennwort|login|use |identified|bearer|basic|-u |://|密|口令|AKIA|ASIA|AIza|gh[pousr]_|github_pat|glpat|xox|npm_|pypi-|k_live|k_test|whsec|SG\.|pat_|dop_v1|hf_|eyJ|-p")


def weak(value: str, bare: bool) -> bool:
    """A value that opens nothing: a placeholder, a reference, a plain word or number, a digest with its method."""
    if len(value) < 6 or PLACEHOLDER.search(value) or HASHED.match(value) or CERTAIN.search(value) is None and ("://" in value or " " in value):
        return True
    if bare and re.match(r"[A-Za-z_]\w*=", value):  # the next argument, with its default
        return True
    digits, lower, upper = sum(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)
    if digits == len(value) or re.fullmatch(r"[\d.,:\-+/]+", value):
        return True
    if digits and (lower or upper):
        return bool(re.fullmatch(r"v?\d+(?:\.\d+)*[a-z]{0,2}|\d+(?:ms|s|m|h|d|kb|mb|gb|px|em|%)", value, re.I)) or bare and len(value) < 8
    # without digits only what is no word or chain of words counts
    mixed = len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value)) + len(re.findall(r"[^A-Za-z]", value)) // 2
    return not (lower and upper and len(value) >= 10 and mixed >= 3)


def _strip(value: str) -> str:
    return value.strip().rstrip("\\").strip()


def _first(m: re.Match) -> tuple[str, bool]:
    """The group that took part, and whether it stood without quotes."""
    groups = m.groups()
    k = next((i for i, g in enumerate(groups) if g is not None), None)
    return ("", True) if k is None else (groups[k], k >= 3)


def on_line(line: str) -> Iterator[tuple[str, str]]:
    """(form, value) of each literal on a line that may be a credential."""
    for m in CERTAIN.finditer(line):
        yield "issued", m.group(0)
    for pattern, form in ((NAMED, "named"), (SPACED, "named"), (ATTRIBUTE, "named")):
        for m in pattern.finditer(line):
            value, bare = _first(m)
            yield form + ("-bare" if bare and form == "named" else ""), value
    for m in ELEMENT.finditer(line):
        yield "named", m.group(2)
    for m in HEADER.finditer(line):
        yield "header", m.group(1)
    for m in BASIC.finditer(line):
        try:
            plain = base64.b64decode(m.group(1) + "==", validate=False).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError):
            continue
        if ":" in plain and not weak(plain.split(":", 1)[1], False):
            yield "basic", m.group(1)
    for m in ADDRESS.finditer(line):
        yield "address", m.group(1)
    for m in CONNECTION.finditer(line):
        yield "address", m.group(1)
    for m in SPOKEN.finditer(line):
        yield "spoken", next((g for g in m.groups() if g is not None), "").strip("\"'`,;")


def key_end(text: str, begin: int) -> int:
    """The end of the private key whose BEGIN mark ends at ``begin``: its END mark, or without one the end of the line after it."""
    end, after = END_KEY.search(text, begin), BEGIN_KEY.search(text, begin)
    if end and not (after and after.start() < end.start()):
        return end.start()
    stop = text.find("\n", text.find("\n", begin) + 1) if "\n" in text[begin:] else -1
    return stop if stop >= 0 else len(text)


def has_key_body(lines: list[str]) -> bool:
    """Whether 40 characters of base64 follow a BEGIN mark before its END, past headers, blank lines and signs of remarks or strings; the first line is the rest of the mark's own."""
    length = 0
    for k, row in enumerate(p for line in lines for p in line.replace("\\r", "").replace("\\n", "\n").split("\n")):
        if BODY.search(row):
            return True
        if "-----" in row:
            return False
        row = AROUND.sub("", row)
        if k == 0 or not row or KEY_HEADER.match(row):
            continue
        if not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", row):
            return False
        length += len(row)
        if length >= 40:
            return True
    return False


def literals(text: str) -> Iterator[tuple[int, str, str]]:
    """(line_no, form, value) of the literals of a text that may be credentials; a private key counts on its BEGIN line, a value below its name on its own line."""
    lines = text.split("\n")
    for i, raw in enumerate(lines):
        line = raw.rstrip("\r")
        above = BELOW.search(lines[i - 1].rstrip("\r")) if i else None
        if above and (m := LONE.match(line)):
            value, bare = _first(m)
            if not weak(value, bare) and (not bare or len(value) >= 8):
                yield i + 1, "below", value
        if not LIKELY.search(line):
            continue
        if m := BEGIN_KEY.search(line):
            if has_key_body([line[m.end() :], *lines[i + 1 : i + 40]]):
                yield i + 1, "private key", m.group(0)
            continue
        whole = JOINED.sub("", line) if JOINED.search(line) else line
        for form, value in on_line(whole):
            value = _strip(value)
            if form in ("issued", "basic") or value and not weak(value, form == "named-bare"):
                yield i + 1, form, value
