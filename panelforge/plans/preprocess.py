"""Preprocessing pipeline of a wide panel with an audit table for every decision (PP3).

Which columns stay depends on the data, so each of stages 1, 2, 4 and 5 runs one profiling job, decides on the driver over column
names, and goes on lazily. Stage 0's rows are written once, as all later stages read them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import quoted
from panelforge.operators import clean, encode, sentinels
from panelforge.operators.encode import column_role
from panelforge.operators.project import numeric_columns, require_columns


@dataclass
class RootPolicy:
    """How a root's columns are encoded: binary (mapping), ordinal (ordered values or identity), nominal (codes), continuous."""

    kind: str
    mapping: Mapping[float, float] | None = None
    ordered: Sequence[float] | None = None
    codes: Sequence[float] | None = None


@dataclass
class Policy:
    target: str
    keep_ids: Sequence[str] = ()
    drop_ids: Sequence[str] = ()
    target_history: Sequence[str] = ()
    leakage: Sequence[str] = ()
    codes: Sequence[float] = sentinels.SENTINEL_CODES
    root_overrides: Mapping[str, Sequence[float]] = field(default_factory=dict)
    fallback_to_observed: bool = True
    label_terms: Sequence[str] = sentinels.MISSING_TERMS
    baseline_roots: Sequence[str] = ()
    baseline_waves: tuple[int, int] = (2, 7)
    baseline_only_if_missing: bool = True
    partial_missing_threshold: float = 0.6
    drop_partial_missing: bool = True
    correlation_threshold: float = 0.98
    prune_correlated: bool = False
    encodings: Mapping[str, RootPolicy] = field(default_factory=dict)


@dataclass
class Preprocessed:
    data: DataFrame
    audits: dict[str, list[dict]]
    summary: dict


def _stage1(df: DataFrame, p: Policy, audits: dict) -> DataFrame:
    profile = {r["column_name"]: r.asDict() for r in clean.profile_columns(df, codes=p.codes).collect()}
    audits["stage1_column_profile"] = [profile[c] for c in df.columns]
    protected = {*p.keep_ids, p.target}
    roots: dict[str, list[str]] = {}
    for c in df.columns:
        role = column_role(c)
        if role.root.lower() in {r.lower() for r in p.baseline_roots} and role.wave and not role.static and p.baseline_waves[0] <= role.wave <= p.baseline_waves[1]:
            roots.setdefault(role.root, []).append(c)
    empty = lambda c: profile[c]["valid_count"] == 0
    baseline = {c for cols in roots.values() if not p.baseline_only_if_missing or all(map(empty, cols)) for c in cols}
    audits["stage1_w1_only_over_time_check"] = [{"root": r, "column_name": c, "all_missing": empty(c), "dropped": c in baseline} for r, cols in sorted(roots.items()) for c in cols]
    reasons: dict[str, str] = {}
    tests = [
        ("baseline_only_over_time", lambda c: c in baseline),
        ("secondary_identifier", lambda c: c in p.drop_ids),
        ("target_history", lambda c: c in p.target_history),
        ("all_effectively_missing", empty),
        ("single_unique_valid", lambda c: profile[c]["nunique_valid"] == 1),
        ("partial_missing_over_threshold", lambda c: p.drop_partial_missing and profile[c]["effective_missing_rate"] > p.partial_missing_threshold),
    ]
    for c in df.columns:
        if c not in protected:
            reason = next((name for name, test in tests if test(c)), None)
            if reason:
                reasons[c] = reason
    audits["stage1_id_policy"] = [{"column_name": c, "action": "keep"} for c in p.keep_ids] + [{"column_name": c, "action": "drop", "present": c in df.columns} for c in p.drop_ids]
    audits["stage1_target_policy"] = [{"column_name": p.target, "action": "keep"}] + [{"column_name": c, "action": "drop", "present": c in df.columns} for c in p.target_history]
    for table, reason in (("stage1_unusable_all_effectively_missing", "all_effectively_missing"), ("stage1_unusable_single_unique_valid", "single_unique_valid")):
        audits[table] = [profile[c] for c, r in reasons.items() if r == reason]
    audits["stage1_partial_missing_over_threshold"] = [profile[c] for c in df.columns if c not in protected and not empty(c) and profile[c]["effective_missing_rate"] > p.partial_missing_threshold]
    audits["stage1_obvious_remove_features"] = [{"column_name": c, "reason": r} for c, r in reasons.items()]
    return df.select(*(quoted(c) for c in df.columns if c not in reasons))


def _stage2(df: DataFrame, p: Policy, audits: dict) -> DataFrame:
    columns = [c for c in df.columns if c not in p.keep_ids and column_role(c).wave is not None]
    seen: dict[str, set] = {}
    for r in sentinels.observed_codes(df, columns, p.codes).collect() if columns else []:
        seen.setdefault(r["column_name"], set()).add(r["code"])
    labelled: dict[str, set] = {}
    for r in sentinels.label_codes(df, columns, p.label_terms).collect():
        labelled.setdefault(r["column_name"], set()).add(r["code"])
    chosen = sentinels.choose_codes(columns, p.root_overrides, labelled, seen, p.fallback_to_observed)
    rows = [{"column_name": c, "status": s, "codes": codes, "observed": sorted(seen.get(c, ())), "labelled": sorted(labelled.get(c, ()))} for c, (s, codes) in chosen.items()]
    audits["stage2_column_sentinel_validation"] = rows
    audits["stage2_status_counts"] = [{"status": s, "n": sum(r["status"] == s for r in rows)} for s in sorted({r["status"] for r in rows})]
    audits["stage2_observed_overcapture_columns"] = [r for r in rows if set(r["observed"]) - set(r["codes"])]
    audits["stage2_observed_undercapture_columns"] = [r for r in rows if set(r["codes"]) - set(r["observed"])]
    final = {c: codes for c, (_, codes) in chosen.items() if codes}
    audits["stage2_sentinel_final_map"] = [{"column_name": c, "codes": v} for c, v in final.items()]
    audits["stage2_sentinel_final_map_compact"] = [{"root": r, "waves": w, "codes": v} for r, w, v in sentinels.compact_map(chosen)]
    audits["stage2_sentinel_replacement_summary"] = [r.asDict() for r in sentinels.replacement_counts(df, final).collect()] if final else []
    return sentinels.replace_sentinels(df, final)


def _stage3(df: DataFrame, p: Policy, audits: dict) -> DataFrame:
    gone = [c for c in p.leakage if c in df.columns and c != p.target]
    audits["stage3_leakage_policy"] = [{"column_name": c, "present": c in df.columns} for c in p.leakage]
    audits["stage3_leakage_dropped_features"] = [{"column_name": c} for c in gone]
    return df.drop(*gone)


def _stage4(df: DataFrame, p: Policy, audits: dict) -> DataFrame:
    predictors = [c for c in numeric_columns(df, [p.target, *p.keep_ids])]
    profile = [r.asDict() for r in clean.profile_columns(df, [c for c in df.columns if c not in (p.target, *p.keep_ids)]).collect()] if len(df.columns) > 1 else []
    rates = {r["column_name"]: r["effective_missing_rate"] for r in profile}
    audits["stage4_predictor_missingness_target_filtered"] = sorted(profile, key=lambda r: (-r["effective_missing_rate"], r["column_name"]))
    pairs = [r.asDict() for r in clean.spearman_pairs(df, predictors, threshold=p.correlation_threshold).collect()] if len(predictors) > 1 else []
    pairs.sort(key=lambda r: (-r["abs_rho"], r["feature_a"], r["feature_b"]))
    audits["stage4_high_correlation_pairs"] = pairs
    dropped = clean.prune_correlated([(r["feature_a"], r["feature_b"], r["abs_rho"]) for r in pairs], rates)
    audits["stage4_high_correlation_dropped_features"] = [{"column_name": a, "kept": b, "reason": r, "abs_rho": rho, "applied": p.prune_correlated} for a, b, r, rho in dropped]
    return df.drop(*(a for a, *_ in dropped)) if p.prune_correlated else df


def _stage5(df: DataFrame, p: Policy, audits: dict) -> DataFrame:
    predictors = [c for c in df.columns if c not in (p.target, *p.keep_ids)]
    policies = {r.lower(): x for r, x in p.encodings.items()}
    unknown = [c for c in predictors if column_role(c).root.lower() not in policies]
    audits["stage5_root_policy_table"] = [{"root": r, "kind": x.kind} for r, x in sorted(p.encodings.items())]
    audits["stage5_feature_policy_assignment"] = [{"column_name": c, "root": column_role(c).root, "kind": policies[column_role(c).root.lower()].kind} for c in predictors if c not in unknown]
    audits["stage5_unconfigured_predictor_features"] = [{"column_name": c} for c in unknown]
    encode.require_policy(predictors, list(p.encodings))
    made, nominal, mapped = [], {}, {"binary": [], "ordinal": [], "continuous": []}
    for c in df.columns:
        x = policies.get(column_role(c).root.lower()) if c in predictors else None
        if x is None:
            made.append(F.col(quoted(c)))
            continue
        if x.kind == "nominal":
            nominal[c] = list(x.codes or ())
            made.append(F.col(quoted(c)))
            continue
        if x.kind == "binary":
            value = encode.binary(df, c, x.mapping or {})
        elif x.kind == "ordinal":
            value = encode.ordinal(df, c, x.ordered)
        elif x.kind == "continuous":
            value = encode.ordinal(df, c)
        else:
            raise InputValidationError(f"unknown encoding {x.kind!r}")
        mapped[x.kind].append((c, F.count_if(F.col(quoted(c)).isNotNull() & value.isNull())))
        made.append(value.alias(c))
    counts = df.agg(*(e.alias(f"u{i}") for i, (_, e) in enumerate(x for v in mapped.values() for x in v))).first() if any(mapped.values()) else []
    lost = dict(zip([c for v in mapped.values() for c, _ in v], counts))
    for kind, table in (("binary", "stage5_binary_mapping_summary"), ("ordinal", "stage5_ordinal_mapping_summary"), ("continuous", "stage5_continuous_keep_summary")):
        audits[table] = [{"column_name": c, "unmapped": lost[c]} for c, _ in mapped[kind]]
    out = encode.one_hot(df.select(*made), nominal) if nominal else df.select(*made)
    created = [encode.one_hot_name(c, v) for c, codes in nominal.items() for v in codes]
    audits["stage5_nominal_one_hot_created_columns"] = [{"source": c, "column_name": encode.one_hot_name(c, v), "code": v} for c, codes in nominal.items() for v in codes]
    audits["stage5_nominal_one_hot_dropped_sources"] = [{"column_name": c} for c in nominal]
    own = [c for c in out.columns if c not in (p.target, *p.keep_ids)]
    profile = [r.asDict() for r in clean.profile_columns(out, own).collect()] if own else []
    constant = {r["column_name"] for r in profile if r["nunique_valid"] <= 1}
    audits["stage5_constant_predictor_profile"] = [r for r in profile if r["column_name"] in constant]
    audits["stage5_constant_predictor_dropped_features"] = [{"column_name": c} for c in own if c in constant]
    out = out.drop(*constant)
    renamed = encode.single_wave_names(created, out.columns)
    audits["stage5_nominal_single_wave_reclassified_columns"] = [{"column_name": a, "renamed": b} for a, b in renamed.items()]
    audits["stage5_encoding_summary_counts"] = [{"kind": k, "columns": len(v)} for k, v in mapped.items()] + [{"kind": "nominal", "columns": len(nominal)}]
    return out.withColumnsRenamed(renamed)


def preprocess(df: DataFrame, policy: Policy) -> Preprocessed:
    """Stages 0 target rows, 1 structure, 2 sentinels, 3 leakage, 4 correlation, 5 encoding; 33 audit tables."""
    require_columns(df, [policy.target, *policy.keep_ids])
    audits: dict[str, list[dict]] = {"stage0_target_row_policy": [sentinels.target_row_summary(df, policy.target, policy.codes).first().asDict()]}
    data = cut(sentinels.target_rows(df, policy.target, policy.codes))
    summary = {"columns": {"input": len(df.columns)}}
    for name, stage in (("stage1", _stage1), ("stage2", _stage2), ("stage3", _stage3), ("stage4", _stage4), ("stage5", _stage5)):
        data = stage(data, policy, audits)
        summary["columns"][name] = len(data.columns)
    summary["rows"] = audits["stage0_target_row_policy"][0]
    return Preprocessed(data, audits, summary)


def write_audits(result: Preprocessed, folder: str) -> list[str]:
    """One CSV per audit table and a summary; these are small tables of column names."""
    import csv
    from pathlib import Path

    from panelforge.sources.files import write_json

    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, rows in result.audits.items():
        path = Path(folder, f"{name}.csv")
        with path.open("w", newline="") as f:
            writer = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else ["column_name"], extrasaction="ignore")
            writer.writeheader()
            writer.writerows(rows)
        out.append(str(path))
    return [*out, write_json(result.summary, str(Path(folder, "pipeline_summary.json")))]
