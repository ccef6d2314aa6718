"""The approval workflow as one set-based transform.

An expense moves at most three times: a draft is submitted (or deleted), a pending
one is decided, an approved one is reimbursed. So the outcome of a batch of actions
follows from three milestones per expense, each the earliest eligible action after
the milestone before it. A milestone is a minimum, which Spark aggregates partially
before the shuffle; no expense's actions are ever gathered in one place. Expenses
with very many actions are salted over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark import fixed
from spendspark.functions.scalars import display_name, is_blank, let, trim_all
from spendspark.operators.checks import claim_amount, claim_date, expense_errors
from spendspark.operators.views import assign_approver, number_approvers
from spendspark.plans.skew import Salting
from spendspark.session import cut

PAYLOAD = ["title", "description", "amount", "currency", "expense_date", "vendor", "category",
           "receipt_url", "receipt_filename"]
OWNER_ACTIONS = ["update", "submit", "delete"]
DECISIONS = ["approve", "reject", "request_changes"]
KNOWN_ACTIONS = ["create", "comment", "reimburse", *OWNER_ACTIONS, *DECISIONS]
NEW_STATE = {action: to for action, (_, to, _, _) in fixed.TRANSITIONS.items()}


class WorkflowResult:
    """What a batch of actions leaves behind. The outputs are built when asked for;
    the decided actions and the moved expenses, which several of them read, are
    written once (keep)."""

    def __init__(self, expenses: DataFrame, milestones: DataFrame, decide: Callable[[], DataFrame],
                 move: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]):
        self._expenses, self._milestones, self._decide, self._move, self._keep = expenses, milestones, decide, move, keep

    @cached_property
    def _decided(self) -> DataFrame:
        return self._keep(self._decide())

    @cached_property
    def _accepted(self) -> DataFrame:
        return self._decided.filter(F.col("reason").isNull())

    @cached_property
    def _moved(self) -> DataFrame:
        return self._keep(self._move(self._accepted))

    @staticmethod
    def _standing(rows: DataFrame) -> DataFrame:
        """Rows of expenses that were not deleted."""
        return rows.filter(F.coalesce(F.col("m1_action") != "delete", F.lit(True)))

    @property
    def changed(self) -> DataFrame:
        """New state of the expenses that the actions changed or created."""
        return self._standing(self._moved).select(*self._expenses.columns)

    @property
    def expenses(self) -> DataFrame:
        """New state of all expenses."""
        moved = self._moved.select(F.col("id").alias("moved_id"))
        untouched = self._expenses.join(moved, F.col("id") == F.col("moved_id"), "left_anti")
        return untouched.unionByName(self.changed)

    @property
    def audit(self) -> DataFrame:
        return _audit(self._standing(self._moved), self._standing(self._accepted))

    @property
    def notifications(self) -> DataFrame:
        return _notifications(self._standing(self._moved))

    @property
    def comments(self) -> DataFrame:
        return _comments(self._standing(self._moved), self._standing(self._accepted))

    @property
    def rejected(self) -> DataFrame:
        return self._decided.filter(F.col("reason").isNotNull()).select(
            "action_id", "expense_id", "actor_id", "action", "ts", "reason")

    @property
    def deleted(self) -> DataFrame:
        return self._milestones.filter(F.col("m1_action") == "delete").select(F.col("m_id").alias("expense_id"))

    @property
    def ocr_jobs(self) -> DataFrame:
        return _ocr_jobs(self._standing(self._accepted))

    @property
    def feedback(self) -> DataFrame:
        return _feedback(self._standing(self._moved))


def _among(column: Column, values: dict[str, str]) -> Column:
    """Lookup of a text column in a small dictionary, null elsewhere."""
    result = F.lit(None).cast("string")
    for key, value in values.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def _before(milestone: str) -> Column:
    """The milestone happened before the action of this row."""
    earlier = (F.col(f"{milestone}_ts") < F.col("ts")) | (
        (F.col(f"{milestone}_ts") == F.col("ts")) & (F.col(f"{milestone}_action_id") < F.col("action_id")))
    return F.coalesce(earlier, F.lit(False))


def _with_actor(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Actions with their actor and, as early_reason, the refusals that depend on
    neither the expense nor its state."""
    missing = [c for c in [*PAYLOAD, "is_internal"] if c not in actions.columns]
    acts = actions.withColumns({
        c: F.lit(None).cast("boolean" if c == "is_internal" else "string") for c in missing}) if missing else actions
    actor = users.select(
        F.col("id").alias("a_id"), F.col("role").alias("a_role"), F.col("is_active").alias("a_active"),
        display_name(F.col("first_name"), F.col("last_name")).alias("actor_name"))
    joined = acts.join(actor, F.col("actor_id") == F.col("a_id"), "left")
    action, role = F.col("action"), F.col("a_role")
    invalid = let(expense_errors(), lambda e: F.when(
        F.size(e) > 0, F.concat(F.lit("Validation failed: "), F.array_join(e, ", "))))
    early = (
        F.when(F.col("a_id").isNull(), fixed.REFUSE_UNKNOWN_ACTOR)
        .when(~F.coalesce(F.col("a_active"), F.lit(False)), fixed.REFUSE_INACTIVE_ACTOR)
        .when(~action.isin(KNOWN_ACTIONS), "Unknown action")
        .when(action.isin(DECISIONS) & ~role.isin(fixed.PRIVILEGED_ROLES), fixed.REFUSE_ROLE)
        .when((action == "reimburse") & (role != "admin"), fixed.REFUSE_ROLE)
        .when(action.isin(list(fixed.REFUSE_TEXT)) & is_blank(F.col("notes")), _among(action, fixed.REFUSE_TEXT))
        .when(action.isin("create", "update"), invalid)
    )
    return joined.withColumn("early_reason", early)


def _created(prepared: DataFrame, expenses: DataFrame) -> DataFrame:
    """First valid create action of each id that is not taken."""
    fields = ["ts", "action_id", "actor_id", *PAYLOAD]
    first = prepared.filter((F.col("action") == "create") & F.col("early_reason").isNull()).groupBy(
        F.col("expense_id").alias("new_id")).agg(F.min(F.struct(*fields)).alias("first"))
    flat = first.select("new_id", *[F.col(f"first.{f}").alias(f"born_{f}") for f in fields])
    return flat.join(expenses.select("id"), F.col("new_id") == F.col("id"), "left_anti")


def _new_expense_rows(created: DataFrame, expenses: DataFrame) -> DataFrame:
    """Created expenses in the column layout of the expense table."""
    born = {c: F.col(f"born_{c}") for c in PAYLOAD}
    values = {
        "id": F.col("new_id"), "user_id": F.col("born_actor_id"), "status": F.lit("draft"),
        "created_at": F.col("born_ts"), "updated_at": F.col("born_ts"), "ocr_status": F.lit("pending"),
        **_payload_values(born),
        "receipt_url": born["receipt_url"], "receipt_filename": born["receipt_filename"],
    }
    return created.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in expenses.schema.fields],
        "born_ts", "born_action_id", "born_actor_id")


def _payload_values(raw: dict[str, Column]) -> dict[str, Column]:
    return {
        "title": trim_all(raw["title"]), "description": trim_all(raw["description"]),
        "amount": claim_amount(raw["amount"]),
        "currency": F.coalesce(raw["currency"], F.lit(fixed.DEFAULT_CURRENCY)),
        "expense_date": claim_date(raw["expense_date"]), "vendor": trim_all(raw["vendor"]),
        "category": raw["category"],
    }


# what decides the state, and what the outputs tell besides
_MILESTONE_FIELDS = ["ts", "action_id", "action"]
_TOLD_FIELDS = ["actor_id", "actor_name", "notes"]
_KINDS = 16  # more than there are actions
_LOWEST_ID = 1 << 63
_SPAN = _KINDS << 64


def _milestone_columns(name: str, fields: list[str]) -> list[str]:
    return [f"{name}_{field}" for field in fields]


def _exact(value: Column | int) -> Column:
    return (F.lit(str(value)) if isinstance(value, int) else value).cast("decimal(38,0)")


def _rank_of() -> Column:
    """(ts, action_id) and the kind of action as one number in the same order: a value that a
    hash aggregate can keep in place, which it can't a row with text in it."""
    kind = F.coalesce(*[F.when(F.col("action") == a, i) for i, a in enumerate(KNOWN_ACTIONS)])
    number = (_exact(F.col("action_id")) + _exact(_LOWEST_ID)) * F.lit(_KINDS) + kind
    return _exact(_exact(F.unix_micros("ts")) * _exact(_SPAN) + number)


def _from_rank(rank: Column) -> dict[str, Column]:
    """The milestone fields of a number that _rank_of made."""
    def whole(value: Column, parts: int) -> Column:
        return F.call_function("div", _exact(value), _exact(parts))

    low = F.pmod(rank, _exact(_SPAN))
    kind = F.pmod(low, _exact(_KINDS))
    return {"ts": F.timestamp_micros(whole(rank - low, _SPAN)),
            "action_id": whole(low - kind - _exact(_LOWEST_ID * _KINDS), _KINDS),
            "action": F.get(F.array(*[F.lit(a) for a in KNOWN_ACTIONS]), kind.cast("int"))}


def _earliest(rows: DataFrame, name: str) -> DataFrame:
    """First of the rows per expense, as flat columns <name>_ts, <name>_action, ..."""
    first = rows.groupBy(F.col("expense_id").alias(f"{name}_id")).agg(F.min(_rank_of()).alias("rank"))
    return first.select(f"{name}_id", *[v.alias(f"{name}_{f}") for f, v in _from_rank(F.col("rank")).items()])


def _told(accepted: DataFrame) -> DataFrame:
    """Who took an expense's milestones, and what they wrote: at most three rows per expense meet."""
    own = {m: F.coalesce(F.col("action_id") == F.col(f"{m}_action_id"), F.lit(False)) for m in ("m1", "m2", "m3")}
    rows = accepted.filter(own["m1"] | own["m2"] | own["m3"]).groupBy(F.col("expense_id").alias("told_id")).agg(
        *[F.max(F.when(hit, F.struct(*_TOLD_FIELDS))).alias(m) for m, hit in own.items()])
    return rows.select("told_id", *[F.col(f"{m}.{f}").alias(f"{m}_{f}") for m in own for f in _TOLD_FIELDS])


def apply_actions(
    expenses: DataFrame,
    actions: DataFrame,
    users: DataFrame,
    *,
    forbid_self: bool = False,
    seed: int = 0,
    bucket: Column | None = None,
    pick: Column | None = None,
    hot_rows: int = 1_000_000,
    salts: int = 64,
    keep=cut,
) -> WorkflowResult:
    """New state of the expenses and everything the accepted actions leave behind.

    actions: action_id (an integer), expense_id, actor_id, action, notes (reason, message or comment
    text), ts, optionally is_internal and the claim fields of create and update as text.
    Each expense's actions take effect in (ts, action_id) order. The time of an effect
    is the ts of its action. A refused action appears in `rejected` with its reason.

    bucket and pick replace the hashes that number the approvers and draw one (see
    assign_approver). forbid_self refuses decisions on own expenses. keep is called
    on the list of hot expenses, the joined actions, the milestones, the decided actions and the
    changed expenses; it writes them to the shared checkpoint folder, since every output reads them.
    """
    if not isinstance(actions.schema["action_id"].dataType, T.IntegralType):
        raise ValueError("action_id must be an integer")
    prepared = _with_actor(actions, users)
    salting = Salting(actions, "expense_id", "action_id", hot_rows, salts, keep)
    created = _created(prepared, expenses)
    slots = number_approvers(users, bucket=bucket)
    approvers = slots.agg(F.count(F.lit(1)).alias("n")).scalar()

    births = created.select(
        F.col("new_id").alias("b_id"), F.col("born_actor_id").alias("b_owner"), F.lit("draft").alias("b_status"),
        F.col("born_ts").alias("b_born_ts"), F.col("born_action_id").alias("b_born_action_id"))
    base = expenses.select(
        F.col("id").alias("b_id"), F.col("user_id").alias("b_owner"), F.col("status").alias("b_status"),
        F.lit(None).cast("timestamp").alias("b_born_ts"),
        F.lit(None).cast(births.schema["b_born_action_id"].dataType).alias("b_born_action_id"),
    ).unionByName(births)

    met = keep(salting.meet(salting.scatter(prepared), base, "b_id").withColumn("approvers", approvers))

    action = F.col("action")
    own = F.coalesce(F.col("b_owner") == F.col("actor_id"), F.lit(False))
    there = F.col("b_id").isNotNull() & (F.col("b_born_ts").isNull() | _before("b_born"))
    able = met.filter(F.col("early_reason").isNull() & there)
    if forbid_self:
        able = able.filter(~(action.isin(DECISIONS) & own))

    m1 = _earliest(able.filter(
        own & (F.col("b_status") == "draft")
        & ((action == "delete") | ((action == "submit") & (F.col("approvers") > 0)))), "m1")

    after_m1 = salting.meet(able.filter(action.isin(DECISIONS)), m1, "m1_id")
    m2 = _earliest(after_m1.filter(
        (F.col("b_status") == "pending")
        | ((F.col("b_status") == "draft") & (F.col("m1_action") == "submit") & _before("m1"))), "m2")

    after_m2 = salting.meet(able.filter(action == "reimburse"), m2, "m2_id")
    m3 = _earliest(after_m2.filter(
        (F.col("b_status") == "approved") | ((F.col("m2_action") == "approve") & _before("m2"))), "m3")

    milestones = keep(
        m1.join(m2, F.col("m1_id") == F.col("m2_id"), "full_outer")
        .join(m3, F.coalesce("m1_id", "m2_id") == F.col("m3_id"), "full_outer")
        .select(F.coalesce("m1_id", "m2_id", "m3_id").alias("m_id"),
                *[c for m in ("m1", "m2", "m3") for c in _milestone_columns(m, _MILESTONE_FIELDS)]))

    decided = salting.meet(met, milestones, "m_id")
    state = (
        F.when(_before("m3"), "reimbursed")
        .when(_before("m2"), _among(F.col("m2_action"), NEW_STATE))
        .when(_before("m1"), F.when(F.col("m1_action") == "submit", "pending").otherwise("gone"))
        .otherwise(F.col("b_status")))
    births_itself = F.coalesce(F.col("b_born_action_id") == F.col("action_id"), F.lit(False))
    needed = _among(action, {a: t[0] for a, t in fixed.TRANSITIONS.items()} | {"update": "draft", "delete": "draft"})
    reason = F.coalesce(
        F.col("early_reason"),
        F.when(action == "create", F.when(~births_itself, "Expense already exists")).otherwise(
            F.when(~there | (state == "gone"), fixed.REFUSE_NOT_FOUND)
            .when(action.isin(OWNER_ACTIONS) & ~own, fixed.REFUSE_NOT_FOUND)
            .when((action == "comment") & ~own & ~F.col("a_role").isin(fixed.PRIVILEGED_ROLES),
                  fixed.REFUSE_COMMENT_ACCESS)
            .when(action.isin(DECISIONS) & own & F.lit(forbid_self), fixed.REFUSE_ROLE)
            .when(needed.isNotNull() & (state != needed), _among(action, fixed.REFUSE_STATE))
            .when((action == "submit") & (F.col("approvers") == 0), fixed.REFUSE_NO_APPROVER)))
    return WorkflowResult(
        expenses, milestones, decide=lambda: decided.withColumn("reason", reason),
        move=lambda accepted: _moved(expenses, created, accepted, milestones, users, seed, bucket, pick), keep=keep)


def _moved(expenses, created, accepted, milestones, users, seed, bucket, pick) -> DataFrame:
    """One row per expense that the actions changed or created, with its fields as they
    are in the end and its milestones m1, m2, m3 beside them."""
    births = _new_expense_rows(created, expenses)
    everyone = expenses.withColumns({
        c: F.lit(None).cast(births.schema[c].dataType) for c in ("born_ts", "born_action_id", "born_actor_id")
    }).unionByName(births)
    latest = accepted.filter(F.col("action").isin("create", "update")).groupBy(
        F.col("expense_id").alias("edit_id")).agg(
        F.max(F.when(F.col("action") == "update", F.struct("ts", "action_id", *PAYLOAD))).alias("edit"),
        # a new receipt replaces the old one, an update without one keeps it
        F.max(F.when(F.col("receipt_url").isNotNull(),
                     F.struct("ts", "action_id", "receipt_url", "receipt_filename"))).alias("receipt"))
    edits = latest.select(
        "edit_id", F.col("edit.ts").alias("edit_ts"), *[F.col(f"edit.{c}").alias(f"edit_{c}") for c in PAYLOAD[:7]],
        *[F.col(f"receipt.{c}").alias(f"edit_{c}") for c in PAYLOAD[7:]])
    facts = edits.join(milestones, F.col("edit_id") == F.col("m_id"), "full_outer").withColumn(
        "fact_id", F.coalesce("edit_id", "m_id")).join(_told(accepted), F.col("m_id") == F.col("told_id"), "left")
    submitted = milestones.filter(F.col("m1_action") == "submit").select(F.col("m_id").alias("sent_id"))
    sent = assign_approver(submitted, users, seed, "sent_id", bucket, pick)

    joined = everyone.join(facts, F.col("id") == F.col("fact_id")).join(sent, F.col("id") == F.col("sent_id"), "left")
    edited, decided = F.col("edit_ts").isNotNull(), F.col("m2_ts").isNotNull()
    values = {c: F.when(edited, v).otherwise(F.col(c))
              for c, v in _payload_values({p: F.col(f"edit_{p}") for p in PAYLOAD}).items()}
    for c in ("receipt_url", "receipt_filename"):
        values[c] = F.when(F.col("edit_receipt_url").isNotNull(), F.col(f"edit_{c}")).otherwise(F.col(c))
    values["status"] = F.coalesce(
        _among(F.col("m3_action"), NEW_STATE), _among(F.col("m2_action"), NEW_STATE),
        _among(F.col("m1_action"), NEW_STATE), F.col("status"))
    values["approver_id"] = F.when(decided, F.col("m2_actor_id")).otherwise(
        F.coalesce(F.col("assigned_to"), F.col("approver_id")))
    values["approval_notes"] = F.when(decided, F.col("m2_notes")).otherwise(F.col("approval_notes"))
    for column, milestone, wanted in (("approved_at", "m2", "approve"), ("rejected_at", "m2", "reject"),
                                      ("reimbursed_at", "m3", "reimburse")):
        values[column] = F.when(F.col(f"{milestone}_action") == wanted, F.col(f"{milestone}_ts")).otherwise(F.col(column))
    touched = F.greatest("edit_ts", "m1_ts", "m2_ts", "m3_ts")
    values["updated_at"] = F.coalesce(touched, F.col("updated_at"))
    types = {f.name: f.dataType for f in expenses.schema.fields}
    return joined.withColumns({c: v.cast(types[c]) for c, v in values.items() if c in types}).select(
        *expenses.columns, "born_ts", "born_action_id", "born_actor_id", "assigned_to",
        *[c for m in ("m1", "m2", "m3") for c in _milestone_columns(m, _MILESTONE_FIELDS + _TOLD_FIELDS)])


def _line(milestone: str, **fields: Column) -> Column:
    return F.struct(F.col(f"{milestone}_action_id").alias("action_id"), F.col("id").alias("expense_id"),
                    *[v.alias(k) for k, v in fields.items()])


def _exploded(rows: DataFrame, lines: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array_compact(F.array(*lines))).alias("line")).select("line.*")


def _audit(kept: DataFrame, accepted: DataFrame) -> DataFrame:
    def entry(milestone: str) -> Column:
        action, notes = F.col(f"{milestone}_action"), F.col(f"{milestone}_notes")
        defaults = {a: t[3] for a, t in fixed.TRANSITIONS.items() if t[3]}
        given = F.when(action.isin("approve", "reimburse"), F.nullif(notes, F.lit(""))).when(action != "submit", notes)
        return F.when(F.col(f"{milestone}_ts").isNotNull(), _line(
            milestone, user_id=F.col(f"{milestone}_actor_id"),
            action=_among(action, {a: t[2] for a, t in fixed.TRANSITIONS.items()}),
            old_status=_among(action, {a: t[0] for a, t in fixed.TRANSITIONS.items()}),
            new_status=_among(action, NEW_STATE),
            notes=F.coalesce(given, _among(action, defaults)), created_at=F.col(f"{milestone}_ts")))

    nothing = F.lit(None).cast("string")
    birth = F.when(F.col("born_ts").isNotNull(), _line(
        "born", user_id=F.col("born_actor_id"), action=F.lit("created"), old_status=nothing,
        new_status=F.lit("draft"), notes=F.lit(fixed.NOTE_CREATED), created_at=F.col("born_ts")))
    moves = _exploded(kept.filter(F.coalesce("born_ts", "m1_ts", "m2_ts", "m3_ts").isNotNull()),
                      [birth, entry("m1"), entry("m2"), entry("m3")])
    internal = F.when(F.col("is_internal"), "Added internal comment").otherwise("Added comment")
    others = accepted.filter(F.col("action").isin("update", "comment")).select(
        "action_id", "expense_id", F.col("actor_id").alias("user_id"),
        F.when(F.col("action") == "update", "updated").otherwise("commented").alias("action"),
        nothing.alias("old_status"), nothing.alias("new_status"),
        F.when(F.col("action") == "update", fixed.NOTE_UPDATED).otherwise(internal).alias("notes"),
        F.col("ts").alias("created_at"))
    return moves.unionByName(others)


def _notifications(kept: DataFrame) -> DataFrame:
    def message(template: str, milestone: str) -> Column:
        """The fixed text with {name} filled in."""
        values = {"actor": F.col(f"{milestone}_actor_name"), "title": F.col("title"),
                  "currency": F.col("currency"), "amount": F.col("amount").cast("string")}
        pieces: list[Column] = []
        for part in template.replace("}", "{").split("{"):
            pieces.append(values[part] if part in values else F.lit(part))
        return F.concat(*pieces)

    def entry(milestone: str, action: str) -> Column:
        kind, title, template = fixed.NOTIFICATIONS[action]
        receiver = F.col("assigned_to") if action == "submit" else F.col("user_id")
        return F.when(F.col(f"{milestone}_action") == action, _line(
            milestone, user_id=receiver, title=F.lit(title), message=message(template, milestone),
            type=F.lit(kind), read=F.lit(False), created_at=F.col(f"{milestone}_ts")))

    lines = [entry("m1", "submit"), *[entry("m2", a) for a in DECISIONS], entry("m3", "reimburse")]
    told = kept.filter(F.coalesce("m1_ts", "m2_ts", "m3_ts").isNotNull())
    return _exploded(told, lines).withColumnRenamed("expense_id", "related_expense_id")


def _comments(kept: DataFrame, accepted: DataFrame) -> DataFrame:
    asked = kept.filter(F.col("m2_action") == "request_changes").select(
        F.col("m2_action_id").alias("action_id"), F.col("id").alias("expense_id"),
        F.col("m2_actor_id").alias("user_id"), F.col("m2_notes").alias("comment"),
        F.lit(False).alias("is_internal"), F.col("m2_ts").alias("created_at"))
    written = accepted.filter(F.col("action") == "comment").select(
        "action_id", "expense_id", F.col("actor_id").alias("user_id"), trim_all(F.col("notes")).alias("comment"),
        F.coalesce("is_internal", F.lit(False)).alias("is_internal"), F.col("ts").alias("created_at"))
    return asked.unionByName(written)


def _ocr_jobs(accepted: DataFrame) -> DataFrame:
    """Latest receipt of each expense that brought one along, to be queued."""
    return accepted.filter(
        F.col("action").isin("create", "update") & F.col("receipt_url").isNotNull()
    ).groupBy("expense_id").agg(F.max(F.struct("ts", "action_id", "receipt_url")).alias("last")).select(
        "expense_id", "last.receipt_url", F.col("last.ts").alias("created_at"))


def _feedback(kept: DataFrame) -> DataFrame:
    suggested = F.col("ml_suggested_category")
    return kept.filter(
        (F.col("m2_action") == "approve") & suggested.isNotNull() & (suggested != F.col("category"))
    ).select(
        F.col("m2_ts").alias("timestamp"), F.col("id").alias("expense_id"), "title", "description", "vendor", "amount",
        suggested.alias("predicted_category"), F.col("category").alias("actual_category"),
        F.col("ml_confidence").alias("confidence"))


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of deleted expenses. The expense reference is found by
    its column: id in expenses, related_expense_id or expense_id elsewhere."""
    result = {}
    gone = deleted.select(F.col("expense_id").alias("gone_id")).distinct()
    for name, df in tables.items():
        column = ("id" if name == "expenses" else
                  "related_expense_id" if "related_expense_id" in df.columns else "expense_id")
        result[name] = df.join(gone, F.col(column) == F.col("gone_id"), "left_anti")
    return result


# --- reconstruction of missing history -----------------------------------------------------


def backfill_status_times(expenses: DataFrame) -> DataFrame:
    """approved_at one day after creation, reimbursed_at three days after that."""
    approved = F.when(F.col("status").isin("approved", "reimbursed"),
                      F.col("created_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("approved_at"))
    return expenses.withColumn("approved_at", approved).withColumn(
        "reimbursed_at", F.when(F.col("status") == "reimbursed", F.col("approved_at") + F.expr("INTERVAL 3 DAYS"))
        .otherwise(F.col("reimbursed_at")))


def backfill_audit(expenses: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows that the present state implies, in one scan. Reimbursements are
    ascribed to the admin with the smallest id."""
    admin = users.filter(F.col("role") == "admin").agg(F.min("id")).scalar()
    status = F.col("status")

    def row(condition, who, action, old, new, notes, at):
        return F.when(condition, F.struct(
            F.col("id").alias("expense_id"), who.alias("user_id"), F.lit(action).alias("action"),
            F.lit(old).cast("string").alias("old_status"), F.lit(new).alias("new_status"),
            F.lit(notes).alias("notes"), at.alias("created_at")))

    reimbursed = (status == "reimbursed") & F.col("reimbursed_at").isNotNull()
    return _exploded(expenses.withColumn("any_admin", admin), [
        row(F.lit(True), F.col("user_id"), "created", None, "draft", fixed.NOTE_CREATED, F.col("created_at")),
        row(status.isin("approved", "reimbursed", "pending"), F.col("user_id"), "submitted", "draft", "pending",
            fixed.TRANSITIONS["submit"][3], F.col("created_at") + F.expr("INTERVAL 5 MINUTES")),
        row(status.isin("approved", "reimbursed") & F.col("approver_id").isNotNull(), F.col("approver_id"),
            "approved", "pending", "approved", fixed.NOTE_APPROVED_BACKFILL, F.col("approved_at")),
        row(reimbursed, F.col("any_admin"), "reimbursed", "approved", "reimbursed",
            fixed.TRANSITIONS["reimburse"][3], F.col("reimbursed_at")),
    ])
