"""Readers of YAML and properties files: key paths with their values."""

from __future__ import annotations

from collections.abc import Iterator


def flatten(prefix: str, node: dict) -> Iterator[tuple[str, object]]:
    """(key path, value): nested keys joined by dots, list items as [i]; no value, no row."""
    for k, v in node.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            yield from flatten(key, v)
        elif isinstance(v, (list, tuple, set)):
            for i, item in enumerate(v):
                at = f"{key}[{i}]"
                if isinstance(item, dict):
                    yield from flatten(at, item)
                elif item is not None:
                    yield at, item
        elif v is not None:
            yield key, v


def yaml_values(content: bytes) -> Iterator[tuple[str, object, str]]:
    """(key path, value, document) of a YAML file's documents; those that are no mappings are passed over."""
    import yaml

    for i, doc in enumerate(yaml.safe_load_all(content)):
        if isinstance(doc, dict):
            for key, value in flatten("", doc):
                yield key, value, f"doc#{i}"


_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            e = text[i + 1]
            if e == "u":
                digits = text[i + 2 : i + 6]
                if len(digits) < 4 or any(d not in "0123456789abcdefABCDEF" for d in digits):
                    raise ValueError("malformed \\uxxxx escape")
                out.append(chr(int(digits, 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(e, e))
            i += 2
        elif c == "\\":
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _logical_lines(text: str) -> Iterator[str]:
    held = None
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.lstrip(" \t\f")
        if held is None and (not line or line[0] in "#!"):
            continue
        line = (held or "") + line
        slashes = len(line) - len(line.rstrip("\\"))
        if slashes % 2:
            held = line[:-1]
        else:
            held = None
            if line:
                yield line
    if held:
        yield held


def properties_values(content: bytes) -> Iterator[tuple[str, str]]:
    """(key, value) of a properties file; a key's last value counts."""
    found: dict[str, str] = {}
    for line in _logical_lines(content.decode("latin-1")):
        i = 0
        while i < len(line) and line[i] not in "=: \t\f":
            i += 2 if line[i] == "\\" else 1
        key, rest = line[:i], line[i:].lstrip(" \t\f")
        if rest[:1] in ("=", ":"):
            rest = rest[1:].lstrip(" \t\f")
        found[_unescape(key)] = _unescape(rest)
    yield from found.items()


def classify(value: object, key: str) -> str:
    """functions.classify.classify_config for one value, inside the extraction task."""
    import re

    if isinstance(value, str):
        if re.fullmatch(r"https?://.*", value):
            return "URL_RESOURCE"
        if "/" in value and " " not in value:
            return "FILE_PATH"
        if re.fullmatch(r"\w+/\w+.*", value, re.ASCII):
            return "MIME_TYPE"
    low = key.lower()
    for words, kind in ((("url", "uri"), "URL_RESOURCE"), (("path", "dir"), "FILE_PATH"), (("pattern", "regex"), "REGEX_PATTERN")):
        if any(w in low for w in words):
            return kind
    return "DATE_FORMAT" if "format" in low and "date" in low else "CONFIGURATION_VALUE"
