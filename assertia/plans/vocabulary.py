"""Reserved roles. Data written under another vocabulary is read by giving its prefix."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Vocabulary:
    prefix: str = "assertia"

    def role(self, name: str) -> str:
        return f"{self.prefix}.{name}"

    @property
    def fragment(self) -> str:
        return self.role("alias.fragment")

    @property
    def slot(self) -> str:
        return self.role("alias.slot")

    @property
    def concept(self) -> str:
        return self.role("alias.concept")

    @property
    def member(self) -> str:
        return self.role("txn.member")
