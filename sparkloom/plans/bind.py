"""Parameters in documents: {{ name }} and ?:name.

A string that holds exactly one placeholder becomes the value with its type if
the value is no string (and the whole string is replaced); otherwise the text is
substituted. Unknown names are null. Lists and maps are bound all the way down.
"""

from __future__ import annotations

import re

_STYLES = (re.compile(r"\{\{\s*([^}\s]+)\s*\}\}"), re.compile(r"\?:([A-Za-z0-9_.一-龥]+)"))


def lookup(data: dict, name: str):
    if name in data:
        return data[name]
    for part in name.split("."):
        if isinstance(data, dict) and part in data:
            data = data[part]
        elif isinstance(data, list) and part.isdigit() and int(part) < len(data):
            data = data[int(part)]
        else:
            return None
    return data


def bind(value, data: dict):
    if isinstance(value, dict):
        return {k: bind(v, data) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [bind(v, data) for v in value]
    if not isinstance(value, str):
        return value
    for style in _STYLES:
        found = list(style.finditer(value))
        if not found:
            continue
        if len(found) == 1:
            got = lookup(data, found[0][1])
            return value.replace(found[0][0], got) if isinstance(got, str) else got
        return style.sub(lambda m: str(lookup(data, m[1])), value)
    return value
