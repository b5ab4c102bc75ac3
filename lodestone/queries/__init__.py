"""The registered queries; importing this package registers all of them."""

from . import evidence, fetch, files, library, matching, memory, planning, plans, rules, state, streams, text, titlecards

__all__ = ["evidence", "fetch", "files", "library", "matching", "memory", "planning", "plans", "rules", "state", "streams", "text", "titlecards"]
