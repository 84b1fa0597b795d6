"""Operators on typed relations.

keyspace(key, type) · strings(key, value) · hash_fields(key, field, value) ·
list_items(key, pos, value) · set_members(key, member) · zset_scores(key, member, score)
"""
