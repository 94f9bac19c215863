"""Literal day-by-day re-statement of the allocation rule, used as brute force in tests."""


def brute_allocate(items, max_jobs=10, line_cap=30, floor_cap=3, job_cap=6):
    """items: list of (job, cast_type, molds) already in priority order.
    Returns list of (index, day, molds)."""
    rem = [m for _, _, m in items]
    out = []
    day = 1
    while any(r > 0 for r in rem):
        jobs_on_day, by_job = set(), {}
        lu = fu = 0
        for i, (job, ct, _) in enumerate(items):
            if rem[i] <= 0:
                continue
            new = job not in jobs_on_day
            if new and len(jobs_on_day) >= max_jobs:
                continue
            if ct == "F":
                cap = floor_cap - fu
            else:
                cap = min(job_cap - by_job.get(job, 0), line_cap - lu)
            if cap <= 0:
                continue
            t = min(rem[i], cap)
            jobs_on_day.add(job)
            out.append((i, day, t))
            rem[i] -= t
            if ct == "F":
                fu += t
            else:
                by_job[job] = by_job.get(job, 0) + t
                lu += t
        day += 1
    return out
