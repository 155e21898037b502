"""Relations with several consumers, and operators that only change the shape of a plan."""

from __future__ import annotations

from pyspark import StorageLevel

from ..relation import Relation, net


class Save:
    """A relation that several others read; materialised once if ``persist``, else left to exchange reuse.

    A reader always sees the whole relation, however late it comes.
    """

    def __init__(self, relation: Relation, persist: bool = False):
        self.relation = relation
        if persist:
            relation.df.persist(StorageLevel.MEMORY_AND_DISK)

    def get_(self) -> Relation:
        return self.relation

    def get(self) -> Relation:
        return net(self.relation)


def save(relation: Relation, persist: bool = False) -> Save:
    return Save(relation, persist)


def dynamic(relation: Relation) -> Relation:
    return relation


def shared(relation: Relation, persist: bool = False) -> Save:
    """``save`` of ``dynamic``. Nothing comes to the driver."""
    return save(dynamic(relation), persist)
