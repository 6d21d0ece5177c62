"""The members of every hierarchy: found in the facts by one distributed scan, navigated in memory.

The scan emits each hierarchy's key path (cut at the first null key), drops repeats before the shuffle,
and adds all prefixes. What comes to the driver is the dimension members themselves, never facts; beyond
a stated number of them the cube is refused rather than cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import InvalidName, MalformedMemberValue, MemberRefHierarchyMismatch, TooManyMembers, UnknownHierarchy, UnknownMember, UnsupportedRelation
from .names import by_bytes, name
from .query import MemberRef
from .schema import Schema

Path = tuple[str, ...]
#: Members of all hierarchies together that the driver holds, some 1 KB each.
MOST_MEMBERS = 2_000_000


@dataclass
class Tree:
    """One hierarchy's members: children by parent path, in byte order; () is the virtual root."""

    children: dict[Path, list[Path]] = field(default_factory=lambda: {(): []})
    levels: list[list[Path]] = field(default_factory=list)
    position: dict[Path, int] = field(default_factory=dict)

    @classmethod
    def of(cls, paths: list[Path], depth: int) -> Tree:
        out = cls(levels=[[] for _ in range(depth)])
        for p in sorted(paths, key=lambda p: [by_bytes(s) for s in p]):  # pre-order: a parent sorts before its children
            out.children.setdefault(p, [])
            out.children[p[:-1]].append(p)
            out.position[p] = len(out.levels[len(p) - 1])
            out.levels[len(p) - 1].append(p)
        return out

    def below(self, at: Path, depth: int):
        """Pre-order members from 1 to `depth` levels below `at`."""
        if depth > 0:
            for child in self.children[at]:
                yield child
                yield from self.below(child, depth - 1)

    def shifted(self, at: Path, by: int) -> Path | None:
        level = self.levels[len(at) - 1]
        i = self.position[at] + by
        return level[i] if 0 <= i < len(level) else None


def member_paths(facts: DataFrame, schema: Schema) -> DataFrame:
    """(hierarchy number, path) of every member, from one scan of the key columns."""
    rows = []
    for number, (_, h) in enumerate(hierarchies(schema)):
        keys = [F.col(f"`{x.key}`").cast("string") for x in h.levels]
        if keys:
            found = F.array(*keys)
            for i in reversed(range(len(keys))):
                found = F.when(keys[i].isNull(), F.array(*keys[:i]).cast("array<string>")).otherwise(found)
            rows.append(F.struct(F.lit(number).alias("h"), found.alias("path")))
    if not rows:
        return facts.sparkSession.createDataFrame([], "h int, path array<string>")
    paths = facts.select(F.explode(F.array(*rows)).alias("r")).select("r.h", "r.path").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))
    return paths.where(F.size("path") > 0).select("h", F.explode(prefixes).alias("path")).distinct()


def hierarchies(schema: Schema) -> list[tuple]:
    return [(d, h) for d in schema.dimensions for h in d.hierarchies]


@dataclass(frozen=True)
class Relation:
    """children, descendants (with depth), siblings, parent or leaves of a member."""

    kind: str
    depth: int = 0

    def to_json(self) -> dict:
        return {"kind": self.kind} | ({"depth": self.depth} if self.kind == "descendants" else {})

    @classmethod
    def from_json(cls, data: dict) -> Relation:
        kind = data.get("kind")
        if kind not in ("children", "descendants", "siblings", "parent", "leaves"):
            raise UnsupportedRelation(relation=kind)
        return cls(kind, int(data.get("depth", 0)))


class Catalogue:
    def __init__(self, facts: DataFrame, schema: Schema, most: int = MOST_MEMBERS):
        own = hierarchies(schema)
        found: list[list[Path]] = [[] for _ in own]
        rows = member_paths(facts, schema).limit(most + 1).collect()  # one more than allowed shows that there are too many
        if len(rows) > most:
            raise TooManyMembers(most=most)
        for row in rows:
            found[row["h"]].append(tuple(row["path"]))
        self.trees: dict[tuple[str, str], Tree] = {}
        for (dim, h), paths in zip(own, found, strict=True):
            for p in sorted(paths):
                try:
                    name(p[-1])
                except InvalidName:
                    raise MalformedMemberValue(dim=dim.name, level=h.levels[len(p) - 1].name, value=p[-1]) from None
            self.trees[dim.name, h.name] = Tree.of(paths, len(h.levels))

    def tree(self, dim: str, hierarchy: str) -> Tree:
        tree = self.trees.get((dim, hierarchy))
        if tree is None:
            raise UnknownHierarchy(dim=dim, hierarchy=hierarchy)
        return tree

    def exists(self, m: MemberRef) -> bool:
        tree = self.trees.get((m.dim, m.hierarchy))
        return tree is not None and m.path in tree.position

    def navigate(self, dim: str, hierarchy: str, at: MemberRef, relation: Relation) -> list[MemberRef]:
        tree = self.tree(dim, hierarchy)
        if (at.dim, at.hierarchy) != (dim, hierarchy):
            raise MemberRefHierarchyMismatch(expected_dim=dim, expected_hierarchy=hierarchy, actual_dim=at.dim, actual_hierarchy=at.hierarchy)
        if at.path not in tree.position:
            raise UnknownMember(dim=dim, hierarchy=hierarchy, path="/".join(at.path))
        if relation.kind == "children":
            found = tree.children[at.path]
        elif relation.kind == "descendants":
            found = list(tree.below(at.path, relation.depth))
        elif relation.kind == "siblings":
            found = [p for p in tree.children[at.path[:-1]] if p != at.path]
        elif relation.kind == "parent":
            found = [at.path[:-1]] if len(at.path) > 1 else []
        elif relation.kind == "leaves":
            found = [p for p in tree.below(at.path, len(tree.levels)) if not tree.children[p]]
        else:
            raise UnsupportedRelation(relation=relation.kind)
        return [MemberRef(dim, hierarchy, p) for p in found]
