"""Settings from the environment, each with a fallback."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

PREFIX = "FOLIOSCAN_"


def env_int(name: str, fallback: int, environ=os.environ) -> int:
    """The whole number that a variable begins with, if it is 1 or more; else the fallback."""
    found = re.match(r"\s*\+?([0-9]+)", environ.get(name, ""))
    return int(found[1]) if found and int(found[1]) > 0 else fallback


@dataclass(frozen=True)
class Config:
    """Where documents are kept, and how many jobs of a kind may run at once."""

    store: str = "folioscan-store"
    indexing: int = 2
    asking: int = 3

    @classmethod
    def read(cls, environ=os.environ) -> Config:
        return cls(environ.get(PREFIX + "STORE", cls.store), env_int(PREFIX + "INDEXING", cls.indexing, environ), env_int(PREFIX + "ASKING", cls.asking, environ))
