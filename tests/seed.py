"""A small organisation with nine claims, for tests with values worked out by hand."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from spendspark import schema

PEOPLE = [  # id, first, last, role, department
    ("u1", "Ada", "Admin", "admin", None), ("u2", "Jo", "Checker", "approver", "Finance"),
    ("u3", "Mia", "Silva", "employee", "Marketing"), ("u4", "Leo", "Santos", "employee", "IT"),
    ("u5", "Eva", "Costa", "employee", "Sales"),
]
CLAIMS = [  # id, user, title, amount, day, vendor, category, status, time of creation
    ("e1", "u3", "Team Lunch Meeting", "85.50", "2024-01-15", "Restaurante Central", "meals", "approved", "14:30"),
    ("e2", "u3", "Uber to Client Office", "25.00", "2024-01-16", "Uber", "transportation", "reimbursed", "09:15"),
    ("e3", "u3", "Adobe Creative Suite", "320.00", "2024-01-20", "Adobe Systems", "software", "pending", "10:00"),
    ("e4", "u4", "AWS Cloud Services", "450.00", "2024-01-18", "Amazon Web Services", "software", "approved", "11:00"),
    ("e5", "u4", "Tech Conference Ticket", "850.00", "2024-01-22", "TechConf Brazil", "training", "pending", "16:45"),
    ("e6", "u4", "Office Supplies", "45.75", "2024-01-25", "Papelaria Central", "office_supplies", "draft", "13:20"),
    ("e7", "u5", "Client Dinner", "180.00", "2024-01-17", "Churrascaria Premium", "meals", "approved", "20:30"),
    ("e8", "u5", "Hotel Stay - Business Trip", "420.00", "2024-01-19", "Hotel Business Center", "accommodation",
     "reimbursed", "22:00"),
    ("e9", "u5", "Flight to São Paulo", "650.00", "2024-01-19", "LATAM Airlines", "travel", "approved", "06:30"),
]


def table(spark, name, rows):
    """Rows as dictionaries; columns left out are null."""
    kind = schema.TABLES[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in rows], kind)


def users(spark):
    return table(spark, "users", [
        dict(id=i, first_name=f, last_name=n, role=r, department=d, email=f"{f.lower()}@example.com", is_active=True,
             created_at=datetime(2024, 1, 1), updated_at=datetime(2024, 1, 1)) for i, f, n, r, d in PEOPLE])


def expenses(spark):
    rows = []
    for i, user, title, amount, day, vendor, category, status, time in CLAIMS:
        created = datetime.fromisoformat(f"{day} {time}:00")
        rows.append(dict(id=i, user_id=user, title=title, amount=Decimal(amount), currency="BRL",
                         expense_date=date.fromisoformat(day), vendor=vendor, category=category, status=status,
                         approver_id="u2" if status in ("approved", "reimbursed") else None,
                         created_at=created, updated_at=created))
    return table(spark, "expenses", rows)


def actions(spark, rows):
    """(id, expense, actor, action, notes) at one minute after the other."""
    data = [(n, e, a, act, notes, datetime(2024, 2, 1, 0, n % 60)) for n, e, a, act, notes in rows]
    return spark.createDataFrame(
        data, "action_id long, expense_id string, actor_id string, action string, notes string, ts timestamp")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.select(key, value).collect()}


def column(name):
    return F.col(name)
