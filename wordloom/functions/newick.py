"""Trees in bracket notation without a stack: brackets' depths are prefix sums, and what is in a bracket follows from an order by depth."""

from __future__ import annotations

import numpy as np


def _outside(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points of a text, whether each stands outside of quotes and of comments in square brackets; the brackets themselves don't)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero((points == ord("'")) | (points == ord("[")) | (points == ord("]")))
    outside = np.ones(len(points), bool)
    quote, note = -1, -1  # where one began; marks are few, so a loop over them does
    for at in marks.tolist():
        c = points[at]
        if quote >= 0:
            if c == ord("'"):
                outside[quote : at + 1] = False
                quote = -1
        elif note >= 0:
            if c == ord("]"):
                outside[note : at + 1] = False
                note = -1
        elif c == ord("'"):
            quote = at
        elif c == ord("["):
            note = at
    if quote >= 0 or note >= 0:
        raise ValueError("a quote or a comment that isn't closed")
    return points, outside


def _about(piece: str) -> tuple[str | None, float | None, float | None]:
    """(label, length, posterior) of what is written after a bracket or comma: a name, comments, and a length after a colon."""
    label, length, posterior, notes = "", None, None, ""
    while (at := piece.find("[")) >= 0 and ("'" not in piece or piece.find("'") > at or piece.rfind("'") < at):
        end = piece.index("]", at)
        notes += piece[at + 1 : end] + ","
        piece = piece[:at] + piece[end + 1 :]
    if "posterior=" in notes:
        posterior = float(notes.split("posterior=")[1].split(",")[0])
    name, colon, number = piece.rpartition(":") if "'" not in piece else _quoted(piece)
    if colon:
        length = float(number)
    else:
        name = number
    label = name.strip(" \n\r\t")
    if len(label) > 1 and label[0] == label[-1] == "'":
        label = label[1:-1].replace("''", "'")
    return label or None, length, posterior


def _quoted(piece: str) -> tuple[str, str, str]:
    end = piece.rindex("'") + 1
    name, colon, number = piece[end:].rpartition(":")
    return (piece[:end] + name, colon, number) if colon else ("", "", piece)


def nodes(newick: str) -> list[tuple]:
    """(node_id, parent_id, child_ord, label, length, posterior) of a tree text; node 0 is the root, ids go by appearance.

    An opening bracket and a comma each begin a node. The bracket that something is in is the last one opened at its depth, and the node that
    the bracket belongs to is the one begun just before it.
    """
    points, outside = _outside(newick)
    end = np.flatnonzero(outside & (points == ord(";")))
    n = int(end[0]) if len(end) else len(points)
    points, outside = points[:n], outside[:n]
    kind = np.zeros(n, np.int8)
    kind[points == ord("(")], kind[points == ord(")")] = 1, -1
    at = np.flatnonzero(outside & ((kind != 0) | (points == ord(","))))
    step = kind[at].astype(np.int64)
    depth = np.cumsum(step)
    if (depth < 0).any():
        raise ValueError(f"a bracket too many at {at[np.argmax(depth < 0)]}")
    if len(depth) and depth[-1]:
        raise ValueError("a bracket that isn't closed")
    begins = step >= 0
    if (begins & (depth == 0)).any():
        raise ValueError("a comma outside of brackets")
    if (step[1:][step[:-1] < 0] > 0).any() or (step[:-1] < 0)[step[1:] > 0].any():
        raise ValueError("a bracket that belongs to no node")
    node = np.cumsum(begins)  # the last one begun
    level = depth + (step < 0)
    order = np.argsort(level, kind="stable")
    opened = np.maximum.accumulate(np.where(step[order] > 0, np.arange(len(order)), 0))
    comma = np.cumsum(step[order] == 0)
    bracket, ord_ = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    bracket[order] = order[opened]
    ord_[order] = comma - comma[opened]
    owner = node[bracket] - 1
    of = np.concatenate([[0], np.where(begins, node, owner)])  # whom the text after each mark is about
    cuts = np.concatenate([[-1], at, [n]]).tolist()
    count = int(node[-1]) if len(node) else 0
    label, length, posterior = [""] * (count + 1), [0.0] * (count + 1), [None] * (count + 1)
    for who, a, b in zip(of.tolist(), cuts, cuts[1:]):
        if b > a + 1:
            name, far, sure = _about(newick[a + 1 : b])
            label[who] = name if name is not None else label[who]
            length[who] = far if far is not None else length[who]
            posterior[who] = sure if sure is not None else posterior[who]
    parents, places = [None, *owner[begins].tolist()], [0, *ord_[begins].tolist()]
    return list(zip(range(count + 1), parents, places, label, length, posterior))


def first_tree(text: str) -> str | None:
    """The tree of a NEXUS text: of the commands TREE name = ... the first one that is marked as rooted, else the first one; without its semicolon.

    Commands end at semicolons outside of quotes and comments. A text without a readable tree command has none.
    """
    try:
        points, outside = _outside(text)
    except ValueError:
        return None
    ends = np.flatnonzero(outside & (points == ord(";"))).tolist()
    found = None
    for a, b in zip([-1, *ends], ends):
        command = text[a + 1 : b]
        word = command.upper().find("TREE")
        before, equals, tree = command[word + 4 :].partition("=") if word >= 0 else ("", "", "")
        if not equals or len(before.strip().strip("*").split()) != 1 or not before[:1].isspace() or command[:word].split()[-1:] not in ([], ["U"], ["u"]) and not command[word - 1].isspace():
            continue
        tree, rooted = tree.strip(), False
        while tree.startswith("[") and "]" in tree:
            note, _, tree = tree[1:].partition("]")
            rooted, tree = rooted or note.strip().upper() == "&R", tree.strip()
        if tree and rooted:
            return tree
        found = found or tree or None
    return found
