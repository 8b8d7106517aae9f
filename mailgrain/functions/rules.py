"""Rules as data: thresholds, bounce prefixes, vocabularies and public suffixes. All are parameters of the functions."""

from __future__ import annotations

from dataclasses import dataclass, field

# Local-part prefixes of envelope senders.
BOUNCE_PREFIXES = (
    "bounce", "bounces", "bounce-md", "bounces-md", "return", "returns", "reply", "sr", "srs0", "srs1", "msprvs1", "msprvs", "prvs",
    "mailer-daemon", "postmaster-bounce", "envelope-from", "bnc", "bn",
)

# Phrases that mean "this link stops the mail", in matching order.
UNSUBSCRIBE_TOKENS = (
    "unsubscribe", "un-subscribe", "opt out", "opt-out", "optout", "stop receiving", "stop these emails", "stop emails", "remove me",
    "remove my email", "no longer wish to receive", "no longer want to receive", "cancel subscription", "cancel my subscription", "end subscription",
    "désabonner", "desabonner", "se désabonner", "désinscription", "desinscription", "me désabonner",
    "abbestellen", "abmelden", "newsletter abbestellen", "vom newsletter abmelden", "austragen",
    "darse de baja", "baja", "cancelar suscripción", "cancelar suscripcion", "anular suscripción",
    "disiscriviti", "cancellati", "annulla iscrizione",
    "cancelar inscrição", "cancelar inscricao", "descadastrar",
    "uitschrijven", "afmelden",
    "avsluta prenumeration", "afmeld", "meld deg av",
    "wypisz się", "wypisz sie", "zrezygnuj",
)

# Phrases that mean "this link leads to where the mail can be stopped".
PREFERENCE_TOKENS = (
    "manage preferences", "email preferences", "manage your preferences", "manage subscriptions", "manage your subscription",
    "subscription preferences", "notification preferences", "update your preferences", "communication preferences",
    "préférences", "preferences", "einstellungen", "e-mail-einstellungen", "preferencias", "preferenze", "voorkeuren",
)

# Fragments of a URL's path and query that mark an endpoint that stops mail.
URL_TOKENS = (
    "unsubscribe", "unsub", "optout", "opt-out", "opt_out", "remove", "desabonner", "desinscription", "abmelden", "abbestellen",
    "uitschrijven", "baja", "cancel-subscription", "email-preferences", "subscription/manage", "list-manage", "preferences", "/leave", "stoppen",
)

#: Second-level registries by country. No network here, so this is a curated part of the public list; unknown suffixes are one label.
_SECOND_LEVEL = {
    "uk": "co org me net ltd plc sch ac gov nhs police", "au": "com net org edu gov asn id", "jp": "co or ne ac ad ed go gr lg",
    "nz": "co net org ac govt geek gen kiwi school", "br": "com net org gov edu", "in": "co net org gen firm ind ac edu res gov",
    "za": "co net org ac gov web", "kr": "co ne or re pe go ac", "cn": "com net org gov edu ac", "tw": "com net org gov edu idv",
    "hk": "com net org gov edu idv", "sg": "com net org gov edu per", "mx": "com net org gob edu", "ar": "com net org gob edu",
    "tr": "com net org gov edu bel pol", "il": "co net org ac gov muni", "th": "co in ac or net go mi", "id": "co net or ac go web sch my",
    "my": "com net org gov edu name", "ph": "com net org gov edu", "ua": "com net org gov edu in", "pl": "com net org gov edu",
}


def public_suffixes() -> frozenset[str]:
    """Suffixes of two labels, and Australia's state schools of three."""
    two = {f"{label}.{country}" for country, labels in _SECOND_LEVEL.items() for label in labels.split()}
    return frozenset(two | {f"{state}.edu.au" for state in "act nsw nt qld sa tas vic wa".split()})


def read_suffixes(lines) -> frozenset[str]:
    """Rules of a public suffix list's ICANN section that have more than one label, wildcards and exceptions with their mark."""
    out = set()
    for line in lines:
        if "END ICANN" in line:
            break
        rule = line.strip()
        if rule and not rule.startswith("//") and "." in rule:
            out.add(rule.lower())
    return frozenset(out)


@dataclass(frozen=True)
class Rules:
    """Normalisation rules; a changed copy is how a rule change is tried."""

    digits: int = 3
    hex: int = 8
    mixed: int = 12
    bounce_prefixes: tuple[str, ...] = BOUNCE_PREFIXES
    suffixes: frozenset[str] = field(default_factory=public_suffixes)


DEFAULT_RULES = Rules()
