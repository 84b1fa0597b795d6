"""A sequential model of the command semantics, written from their description."""

WRONG = "WRONGTYPE Operation against a key holding the wrong kind of value"


class Store:
    def __init__(self):
        self.data = {}

    def run(self, words):
        if not words:
            return ("error", "empty command", None)
        name, a = "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in words[0]), words[1:]
        ok = {"PING": True, "SET": len(a) >= 2, "GET": len(a) == 1, "HSET": len(a) >= 3 and len(a) % 2 == 1, "HGET": len(a) == 2, "DEL": len(a) >= 1, "EXISTS": len(a) >= 1, "KEYS": len(a) == 1, "SAVE": not a}
        if name not in ok:
            return ("error", f"unknown command `{words[0]}`", None)
        if not ok[name]:
            return ("error", "SAVE command takes no arguments" if name == "SAVE" else f"wrong number of arguments for '{name}'", None)
        d = self.data
        if name == "PING":
            return ("simple", "PONG", None)
        if name == "SAVE":
            return ("simple", "OK", None)
        if name == "SET":
            d[a[0]] = a[1]
            return ("simple", "OK", None)
        if name == "GET":
            v = d.get(a[0])
            return ("bulk", v if isinstance(v, str) else None, None)
        if name == "HSET":
            if isinstance(d.get(a[0]), str):
                return ("error", WRONG, None)
            d.setdefault(a[0], {})[a[1]] = a[2]
            return ("integer", None, 1)
        if name == "HGET":
            v = d.get(a[0])
            return ("bulk", v.get(a[1]) if isinstance(v, dict) else None, None)
        if name == "DEL":
            return ("integer", None, sum(d.pop(k, None) is not None for k in a))
        if name == "EXISTS":
            return ("integer", None, sum(k in d for k in a))
        return ("keys", sorted(d) if a[0] == "*" else [], None)

    def rows(self):
        out = set()
        for k, v in self.data.items():
            out |= {(k, "string", None, v)} if isinstance(v, str) else {(k, "hash", f, x) for f, x in v.items()}
        return out


def run_list(ops):
    """Final list of (op, value, arg, a, b)."""
    x = []
    for op, v, arg, a, b in ops:
        n = len(x)
        if op == "LPUSH":
            x.insert(0, v)
        elif op == "RPUSH":
            x.append(v)
        elif op == "LPOP" and x:
            x.pop(0)
        elif op == "RPOP" and x:
            x.pop()
        elif op == "LTRIM":
            lo, hi = (a + n if a < 0 else a), (b + n if b < 0 else b)
            lo, hi = max(lo, 0), min(hi, n - 1)
            x = x[lo : hi + 1] if lo <= hi and lo < n else []
        elif op == "LREM":
            at = [i for i, y in enumerate(x) if y == v]
            gone = set(at if a == 0 else at[:a] if a > 0 else at[a:])
            x = [y for i, y in enumerate(x) if i not in gone]
        elif op.startswith("LINSERT") and v in x:
            i = x.index(v)
            x.insert(i if op.endswith("BEFORE") else i + 1, arg)
    return x


class IntSet:
    """A set that holds integers until it is promoted."""

    def __init__(self, limit):
        self.limit, self.ints, self.strings = limit, set(), None

    @staticmethod
    def number(m):
        body = m[1:] if m[:1] in ("+", "-") else m
        if not body or any(c not in "0123456789" for c in body):
            return None
        n = int(m)
        return n if -(2**63) <= n < 2**63 else None

    def run(self, op, m):
        n = self.number(m)
        if self.strings is None and op == "ADD" and (n is None or len(self.ints) >= self.limit):
            self.strings = {str(i) for i in self.ints}
        if self.strings is not None:
            there, s, x = m in self.strings, self.strings, m
        elif n is None:
            return 0
        else:
            there, s, x = n in self.ints, self.ints, n
        if op == "ADD":
            s.add(x)
            return int(not there)
        if op == "REM":
            s.discard(x)
        return int(there)

    def members(self):
        return {str(i) for i in self.ints} if self.strings is None else self.strings
