"""Plain one-row-at-a-time versions of the sequential operators."""

from collections import defaultdict


def admit(rows, opened):
    """rows: (student, order, amount); opened: student -> balance.  Verdicts by (student, order)."""
    left, out = dict(opened), {}
    for student, order, amount in sorted(rows):
        if left[student] <= 0:
            out[student, order] = "already_paid"
        elif amount > left[student]:
            out[student, order] = "exceeds_balance"
        else:
            out[student, order] = "accepted"
            left[student] -= amount
    return out


def throttle(rows, gap):
    """rows: (key, ts, id).  Allowed flag by id."""
    last, out = {}, {}
    for key, ts, id in sorted(rows):
        out[id] = key not in last or ts - last[key] >= gap
        if out[id]:
            last[key] = ts
    return out


def validity(issues, attempts, ttl):
    """issues: (key, code, ts, id, supersedes); attempts: (key, code, ts, id)."""
    out = {}
    for key, code, ts, id in attempts:
        live = []
        for i in sorted((i for i in issues if i[0] == key and i[2] <= ts), key=lambda i: (i[2], i[3])):
            if i[4]:
                live = []
            live.append(i)
        out[id] = any(i[1] == code and ts < i[2] + ttl for i in live)
    return out


def first_come(rows):
    """rows: (seq, number, mail).  The seqs that win."""
    taken, won = defaultdict(set), set()
    for seq, number, mail in sorted(rows):
        if number in taken["n"] or mail in taken["m"]:
            continue
        taken["n"].add(number)
        taken["m"].add(mail)
        won.add(seq)
    return won
