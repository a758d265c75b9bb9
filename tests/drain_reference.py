"""Line-by-line template mining in plain Python, as the yardstick for the Spark version."""

import re

WILD = "<*>"
VARIABLE = [
    re.compile(p, re.ASCII)
    for p in (
        r"-?\d+(\.\d+)?\Z",
        r"0[xX][0-9a-fA-F]+\Z",
        r"(\d{1,3}\.){3}\d{1,3}\Z",
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z",
        r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d",
    )
]


def variable(token):
    return any(p.match(token) for p in VARIABLE) or (
        token.startswith("/") and len(token.encode()) > 20
    )


def mine(messages, depth=4, threshold=0.5, max_children=100):
    """(templates, assignment): dicts per template in creation order, template number per message."""
    tree, templates, assignment = {}, [], []
    for message in messages:
        words = re.findall(r"[^\t\n\f\r ]+", message)
        if not words:
            assignment.append(None)
            continue
        node = tree.setdefault(len(words), {})
        for word in words[: depth - 1]:
            child = WILD if variable(word) else word
            if child not in node and len(node) >= max_children:
                child = WILD
            node = node.setdefault(child, {})
        leaf = node.setdefault(None, [])
        for number in leaf:
            tokens = templates[number]["tokens"]
            same = sum(a == b or WILD in (a, b) for a, b in zip(words, tokens))
            if same / len(words) >= threshold:
                templates[number]["tokens"] = [
                    a if a == b else WILD for a, b in zip(tokens, words)
                ]
                break
        else:
            number = len(templates)
            templates.append(
                {"tokens": [WILD if variable(w) else w for w in words], "count": 0, "examples": []}
            )
            leaf.append(number)
        templates[number]["count"] += 1
        if len(templates[number]["examples"]) < 3:
            templates[number]["examples"].append(message)
        assignment.append(number)
    return templates, assignment
