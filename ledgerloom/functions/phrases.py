"""Headings as phrases: a small notation that becomes one regular expression for Spark.

Words are separated by any white space.  ``(a | b)`` is a choice, ``[x y]`` may be missing, an apostrophe may be straight,
curly or missing, a dot after a word lets dots stand in the gap that follows, and case never matters.
"""

from __future__ import annotations

import re

FLAGS = "(?iu)"
GAP, DOTTED = r"\s+", r"[.\s]+"


def phrase(text: str) -> str:
    """The pattern of a phrase, without flags."""
    tokens = re.findall(r"[\[\]()|]|[^\s\[\]()|]+", text)
    out: list[str] = []
    gap, lead = "", []  # what stands before the next word; for each open group, whether it is optional

    for k, t in enumerate(tokens):
        last = k + 1 == len(tokens)
        if t in "[(":
            if t == "[" and tokens[tokens.index("]", k) + 1 :] == []:
                out.append("(?:" + gap)  # an optional end brings its own gap
            else:
                out.append(gap + "(?:")
            gap = ""
            lead.append(t)
        elif t == "|":
            out.append("|")
            gap = ""
        elif t in "])":
            lead.pop()
            if t == ")":
                out.append(")")
                gap = GAP
            elif last:
                out.append(")?")
            else:
                out.append(gap + ")?")  # an optional part owns the gap after it
                gap = ""
        else:
            dotted = t.endswith(".")
            word = t.removesuffix(".").replace("'", "['’]?")
            out.append(gap + word)
            gap = DOTTED if dotted else GAP
    return "".join(out)


#: Sections of a domestic filing, in the order that breaks ties on one page: key, title, heading, longest run of pages,
#: whether its absence is shown, place in the output, and how its content is treated.
SEC_SECTIONS = (
    ("income_statement", "Consolidated Statements of Income", "[CONDENSED] CONSOLIDATED STATEMENTS? OF (INCOME | OPERATIONS | EARNINGS) [AND COMPREHENSIVE (INCOME | LOSS)]", 5, True, 3, "statement"),
    ("comprehensive_income", "Consolidated Statements of Comprehensive Income", "[CONDENSED] CONSOLIDATED STATEMENTS? OF COMPREHENSIVE (INCOME | LOSS)", 5, False, 6, "statement"),
    ("balance_sheet", "Consolidated Balance Sheets", "[CONDENSED] CONSOLIDATED (BALANCE SHEETS? | STATEMENTS? OF FINANCIAL CONDITION)", 5, True, 2, "statement"),
    ("cash_flow", "Consolidated Statements of Cash Flows", "[CONDENSED] CONSOLIDATED STATEMENTS? OF CASH FLOWS?", 5, True, 4, "statement"),
    ("stockholders_equity", "Consolidated Statements of Stockholders' Equity", "[CONDENSED] CONSOLIDATED STATEMENTS? OF ([CHANGES IN] (STOCKHOLDERS' | SHAREHOLDERS') (EQUITY | DEFICIT) | CHANGES IN EQUITY)", 5, True, 5, "statement"),
    ("notes", "Notes to Financial Statements", "NOTES TO [THE] [CONDENSED] [CONSOLIDATED] [CONDENSED] [INTERIM] FINANCIAL STATEMENTS", None, True, 7, "notes"),
    ("mda", "Management's Discussion and Analysis", "[Item (2 | 7).] MANAGEMENT'S DISCUSSION AND ANALYSIS [OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS]", None, False, 8, "prose"),
    ("market_risk", "Quantitative and Qualitative Disclosures About Market Risk", "QUANTITATIVE AND QUALITATIVE DISCLOSURES? ABOUT MARKET RISK", None, False, 9, "prose"),
    ("controls", "Controls and Procedures", "[Item 4.] CONTROLS AND PROCEDURES", None, False, 10, "prose"),
    ("legal_proceedings", "Legal Proceedings", "Item [13]. LEGAL PROCEEDINGS", None, False, 11, "prose"),
    ("risk_factors", "Risk Factors", "Item 1A. RISK FACTORS", 25, False, 12, "prose"),
    ("exhibits", "Exhibits", "Item (6|15|16). EXHIBITS", None, False, 13, "list"),
    ("signatures", "Signatures", None, None, False, 14, "prose"),
)

#: Sections of an international report.
IFRS_SECTIONS = (
    ("ifrs_income_statement", "Consolidated Statement of Profit or Loss and Other Comprehensive Income", "[Interim] [Condensed] [Consolidated] Statement of Profit or Loss", None, True, 1, "statement"),
    ("ifrs_balance_sheet", "Consolidated Balance Sheet", "[Interim] [Condensed] [Consolidated] (Balance Sheet | Statement of Financial Position)", None, True, 2, "statement"),
    ("ifrs_equity_changes", "Consolidated Statement of Changes in Equity", "[Interim] [Condensed] [Consolidated] Statement of Changes in Equity", None, True, 3, "statement"),
    ("ifrs_cash_flow", "Consolidated Statement of Cash Flows", "[Interim] [Condensed] [Consolidated] Statement of Cash Flows?", None, True, 4, "statement"),
    ("ifrs_notes", "Notes to the Consolidated Financial Statements", "Notes to [the] [Condensed] [Consolidated] Financial Statements", None, True, 5, "notes"),
)

COVER = ("cover_page", "Cover Page", None, None, False, 1, "cover")

OR_LOSS = r"(?:\s*[(]LOSS[)])?"
#: Forms of headings that the notation can't state.
SPECIAL = {
    "comprehensive_income": phrase("[CONDENSED] CONSOLIDATED STATEMENTS? OF COMPREHENSIVE (INCOME | LOSS)") + OR_LOSS,
    "income_statement": phrase("[CONDENSED] CONSOLIDATED STATEMENTS? OF (INCOME | OPERATIONS | EARNINGS)") + rf"(?:\s+{phrase('AND COMPREHENSIVE (INCOME | LOSS)')}{OR_LOSS})?",
    "stockholders_equity": phrase("[CONDENSED] CONSOLIDATED STATEMENTS? OF") + r"\s+(?:" + phrase("[CHANGES IN] (STOCKHOLDERS' | SHAREHOLDERS')") + r"\s*(?:EQUITY|DEFICIT)|" + phrase("CHANGES IN EQUITY") + ")",
    "mda": r"(?:Item\s+[27][\s.]*)?" + phrase("MANAGEMENT'S DISCUSSION AND ANALYSIS [OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS]"),
    "controls": r"(?:Item\s+[4][\s.]*)?" + phrase("CONTROLS AND PROCEDURES"),
    "legal_proceedings": r"Item\s+[13]" + DOTTED + phrase("LEGAL PROCEEDINGS"),
    "exhibits": r"Item\s+(?:6|1[56])" + DOTTED + "EXHIBITS",
    "signatures": r"(?m:^SIGNATURES?\s*$)",
}


#: Words without which a section's heading can't be on a page; looking for a word takes a small part of a pattern's time.
NEEDED = {
    "income_statement": ("consolidated", "statement"), "comprehensive_income": ("consolidated", "comprehensive"), "balance_sheet": ("consolidated",), "cash_flow": ("consolidated", "cash"), "stockholders_equity": ("consolidated", "statement"),
    "notes": ("notes", "financial", "statements"), "mda": ("discussion", "analysis"), "market_risk": ("quantitative", "disclosure"), "controls": ("controls", "procedures"), "legal_proceedings": ("item", "proceedings"),
    "risk_factors": ("item", "factors"), "exhibits": ("item", "exhibits"), "signatures": ("signature",),
    "ifrs_income_statement": ("statement", "profit"), "ifrs_equity_changes": ("statement", "equity"), "ifrs_cash_flow": ("statement", "cash"), "ifrs_notes": ("notes", "financial", "statements"),
}
#: Characters that a pattern without case takes for s, k or i, and that a text in lower case keeps or cuts in two.
ODD_CASE = "\u017f\u212a\u0130\u0131"


def heading(section: tuple) -> str:
    """The pattern of a section's heading, without flags."""
    return SPECIAL.get(section[0]) or phrase(section[2])


#: Words that mark a report as domestic or international; each counts once, however often it occurs.
SEC_MARKS = (r"(?iu)FORM\s+10-[KQ]", FLAGS + phrase("SECURITIES AND EXCHANGE COMMISSION"), FLAGS + phrase("Central Index Key"))
IFRS_MARKS = (
    r"(?iu)(?:DKK|EUR|GBP|NOK|SEK)['’]?000",
    r"(?U)\bIFRS\b",
    r"(?iU)(?:CVR|Org\.?\s*n(?:o|r|umber))[.\s:]+[\s\d]+",
    FLAGS + phrase("Statement of Profit or Loss"),
    FLAGS + phrase("Statement of Financial Position"),
    FLAGS + "(?:" + "|".join((phrase("Oslo B.rs"), phrase("Oslo Stock Exchange"), "Euronext")) + ")",
)
