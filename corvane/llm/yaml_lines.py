"""A local grammar of YAML, read line by line: indentation, mappings, sequences, flow collections, quoted and block scalars."""

from __future__ import annotations

import re
from collections.abc import Iterable

_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'')
_KEY = re.compile(r'(?:"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|\?[ ]|[^\s"\'#&*!|>%@`\[\]{},\-?:][^#]*?|[\-?:][^\s#][^#]*?)[ ]*:(?=[ \t]|$)')
_BLOCK = re.compile(r"[|>][-+0-9]{0,2}[ \t]*(?:#.*)?$")
_PROPERTY = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]*)+")


def _uncomment(line: str) -> str:
    """Without a comment; a sign within quotes is none."""
    if "#" not in line:
        return line.rstrip()
    out, at = [], 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|(?:^|(?<=[ \t]))#', line):
        if m.group() == "#":
            return line[: m.start()].rstrip()
    return line.rstrip()


def _flow_depth(text: str) -> int | None:
    """Brackets of a flow collection left open; None if they contradict each other or a comma has nothing before it."""
    bare = _QUOTED.sub("s", text)
    if '"' in bare or re.search(r"[\[{,]\s*,", bare):
        return None
    stack = []
    for i, c in enumerate(bare):
        if c in "[{":
            stack.append(c)
        elif c in "]}":
            if not stack or stack.pop() != {"]": "[", "}": "{"}[c]:
                return None
            if not stack and bare[i + 1 :].strip():
                return None
    return len(stack)


def yaml_fault(text: str | Iterable[str]) -> str | None:
    """The fault of a text, or of its parts in order, each of which but the last ends with a line end."""
    parts = [text] if isinstance(text, str) else text
    lines = (line for part in parts for line in part.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n"))
    stack: list[tuple[int, str]] = []  # indentation and kind (map, seq) of the open collections
    block: int | None = None  # indentation that a block scalar must exceed
    flow, flow_text, flow_indent = 0, "", 0
    quote, quote_rest = "", ""
    # What may come next, deeper: "any" after a key or dash without value; "text" after a plain scalar; "no" otherwise.
    deeper, root_scalar = "any", False
    for number, raw in enumerate(lines, 1):
        if block is not None:
            if not raw.strip() or len(raw) - len(raw.lstrip(" ")) > block:
                continue
            block = None
        if quote:
            end = re.search(r'(?<!\\)"' if quote == '"' else r"'(?!')", raw)
            if end:
                quote = ""
                if _uncomment(raw[end.end() :]).strip():
                    return f"text after a quoted scalar in line {number}"
            continue
        line = _uncomment(raw)
        if flow:
            flow_text += " " + line.strip()
            depth = _flow_depth(flow_text)
            if depth is None:
                return f"flow collection broken in line {number}"
            flow = depth
            continue
        body = line.strip()
        if not body:
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            stack, deeper, root_scalar = [], "any", False
            line = line[3:]
            body = line.strip()
            if not body:
                continue
        if line.startswith("%") and not stack:
            continue
        indent = len(line) - len(line.lstrip(" "))
        if line[indent : indent + 1] == "\t" and (deeper != "text" or _KEY.match(body)):
            return f"tab in the indentation of line {number}"
        top = stack[-1][0] if stack else -1
        is_entry = body == "-" or body.startswith("- ")
        is_key = _KEY.match(body) is not None
        if root_scalar:
            if is_key:
                return f"mapping after a scalar in line {number}"
            continue
        if indent > top and stack and deeper == "text":
            # The continuation of a plain scalar.
            if re.search(r":(?:\s|$)", _QUOTED.sub("s", body)):
                return f"mapping within a scalar in line {number}"
            continue
        if indent > top and stack and deeper == "no":
            return f"text after a value in line {number}"
        rooted = bool(stack)
        while stack and stack[-1][0] > indent:
            stack.pop()
        if rooted and not stack:
            return f"indentation of line {number}"
        if stack and stack[-1][0] == indent and stack[-1][1] == "seq" and not is_entry:
            stack.pop()  # a sequence at the indentation of its key
            if not stack or stack[-1][0] != indent:
                return f"no entry in line {number}"
        if stack and stack[-1][0] < indent and deeper != "any":
            return f"indentation of line {number}"
        if stack and stack[-1][0] < indent and top > indent:
            return f"indentation of line {number}"
        while is_entry:
            if not stack or stack[-1][0] < indent:
                stack.append((indent, "seq"))
            elif stack[-1][1] == "map":
                if deeper != "any":
                    return f"entry within a mapping in line {number}"
                stack.append((indent, "seq"))
            rest = body[1:]
            indent += 1 + len(rest) - len(rest.lstrip())
            body = rest.strip()
            is_entry = body == "-" or body.startswith("- ")
            deeper = "any"
            while stack and stack[-1][0] >= indent:
                stack.pop()
            if not body:
                break
        if not body:
            deeper = "any"
            continue
        value = body
        if m := _KEY.match(body):
            if not stack or stack[-1][0] < indent:
                stack.append((indent, "map"))
            elif stack[-1][1] != "map":
                return f"mapping within a sequence in line {number}"
            value = body[m.end() :].strip()
            if not value:
                deeper = "any"
                continue
        elif stack and stack[-1][0] == indent and stack[-1][1] == "map":
            return f"no key in line {number}"
        elif not stack:
            root_scalar = True
        if m := _PROPERTY.match(value):
            value = value[m.end() :]
            if not value:
                deeper = "any"
                continue
        if _BLOCK.match(value):
            block = stack[-1][0] if stack else -1
            deeper = "no"
        elif value[0] in "\"'":
            deeper = "no"
            if m := _QUOTED.match(value):
                if value[m.end() :].strip():
                    return f"text after a quoted scalar in line {number}"
            elif value[0] == "'" and value.count("'") % 2 == 0:
                return f"quotes in line {number}"
            else:
                quote = value[0]
        elif value[0] in "[{":
            deeper = "no"
            root_scalar = False
            depth = _flow_depth(value)
            if depth is None:
                return f"flow collection broken in line {number}"
            flow, flow_text = depth, value
        elif value[0] == "*":
            deeper = "no"
        elif value[0] in "@`%]},|>" or value[0] in "-?:" and len(value) == 1:
            return f"reserved sign in line {number}"
        else:
            deeper = "text"
            if re.search(r":(?:\s|$)", value):
                return f"mapping within a scalar in line {number}"
    if flow:
        return "flow collection left open"
    if quote:
        return "quoted scalar left open"
    return None
