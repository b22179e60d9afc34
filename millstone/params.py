"""Index parameters: a JSON object with getters that are strict about types."""

from __future__ import annotations

import json

from millstone.errors import InvalidError


class Params(dict):
    """A dict whose typed getters see a value of another type as absent."""

    @classmethod
    def from_json(cls, text: str) -> Params:
        try:
            found = json.loads(text)
        except ValueError as e:
            raise InvalidError(f"params are not JSON: {e}") from None
        if not isinstance(found, dict):
            raise InvalidError("params are not a JSON object")
        return cls(found)

    def to_json(self) -> str:
        return json.dumps(self, indent=4, ensure_ascii=False)

    def _typed(self, key: str, test):
        value = self.get(key)
        return value if test(value) else None

    def get_str(self, key: str) -> str | None:
        return self._typed(key, lambda v: isinstance(v, str))

    def get_uint(self, key: str) -> int | None:
        return self._typed(key, lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0)

    def get_bool(self, key: str) -> bool | None:
        return self._typed(key, lambda v: isinstance(v, bool))

    def get_strlist(self, key: str) -> list[str] | None:
        return self._typed(key, lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v))
