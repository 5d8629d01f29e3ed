def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
