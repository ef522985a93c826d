"""Chemistry behind one protocol: a provider that knows molecules where its library is installed, and a lexical stand-in.

The stand-in works on the notation as text: it checks brackets and ring closures, keeps the longest fragment, and takes
hashed runs of atoms as substructures. Its results are marked approximate: notations of one molecule that are written
differently stay different. Operators take any provider, so results get exact where one is given.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One atom, bond, branch or ring closure of the notation.
TOKEN = re.compile(r"\[[^\[\]]+\]|Br|Cl|%\d\d|[BCNOPSFIbcnops]|[-=#$:/\\.()]|\d|\*")
ATOM = re.compile(r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFIbcnops*]")
#: Average atomic masses for the lexical weight.
MASS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904, "Na": 22.99, "K": 39.098, "Si": 28.085}
#: Usual valences for hydrogens that are not written.
VALENCE = {"B": 3, "C": 4, "N": 3, "O": 2, "P": 3, "S": 2, "F": 1, "Cl": 1, "Br": 1, "I": 1}


class Provider(Protocol):
    """What operators ask of a chemistry library. None stands for a structure that cannot be read."""

    approximate: bool

    def match_key(self, smiles: str) -> str | None: ...

    def canonical(self, smiles: str) -> str | None: ...

    def bits(self, smiles: str, size: int, radius: int) -> list[int] | None: ...

    def features(self, smiles: str, radius: int) -> list[int] | None: ...

    def fingerprint(self, smiles: str) -> list[int] | None: ...

    def properties(self, smiles: str) -> dict[str, float] | None: ...


def tokens(smiles: str) -> list[str] | None:
    """The notation's tokens; None if it has other characters or brackets, branches or rings that do not close."""
    found = TOKEN.findall(smiles)
    if not found or "".join(found) != smiles or not ATOM.search(smiles):
        return None
    depth, rings = 0, set()
    for t in found:
        depth += (t == "(") - (t == ")")
        if depth < 0:
            return None
        if t.isdigit() or t[0] == "%":
            rings ^= {t.lstrip("%")}
    return found if not depth and not rings else None


def hashed(text: str, bits: int = 32) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % (1 << bits)


class Lexical:
    """The stand-in."""

    approximate = True

    def canonical(self, smiles: str) -> str | None:
        own = (smiles or "").strip()
        return own if tokens(own) else None

    def match_key(self, smiles: str) -> str | None:
        """The largest fragment by atoms, then by length and text."""
        own = self.canonical(smiles)
        if own is None:
            return None
        parts = [p for p in own.split(".") if p and tokens(p)]
        return max(parts, key=lambda p: (len(ATOM.findall(p)), len(p), p)) if parts else None

    def runs(self, smiles: str, radius: int) -> list[str] | None:
        found = tokens(self.match_key(smiles) or "")
        if not found:
            return None
        atoms = [t for t in found if ATOM.fullmatch(t)]
        return ["".join(atoms[i : i + n]) for n in range(1, radius + 2) for i in range(len(atoms) - n + 1)]

    def bits(self, smiles: str, size: int = 1024, radius: int = 3) -> list[int] | None:
        runs = self.runs(smiles, radius)
        if runs is None:
            return None
        on = {hashed(x) % size for x in runs}
        return [int(i in on) for i in range(size)]

    def features(self, smiles: str, radius: int = 2) -> list[int] | None:
        runs = self.runs(smiles, radius)
        return None if runs is None else sorted({hashed(x) for x in runs})

    def fingerprint(self, smiles: str) -> list[int] | None:
        """Numbers of the bits that are on among 881."""
        runs = self.runs(smiles, 3)
        return None if runs is None else sorted({hashed(f"fp:{x}") % 881 for x in runs})

    def properties(self, smiles: str) -> dict[str, float] | None:
        found = tokens(self.canonical(smiles) or "")
        if not found:
            return None
        atoms = [t for t in found if ATOM.fullmatch(t)]
        weight, donors, acceptors, valence, aromatic = 0.0, 0, 0, 0, 0
        for t in atoms:
            bare = re.sub(r"^\d+|H\d*(?=[+\-\]@\d]|$)|[@+\-\d]", "", t.strip("[]")) or "H"
            symbol = bare if bare in MASS else bare.capitalize() if bare.capitalize() in MASS else bare[:1].upper()
            weight += MASS.get(symbol, 0.0)
            acceptors += symbol in ("N", "O")
            hydrogens = re.search(r"H(\d*)(?=[+\-\]@\d]|$)", t[:-1]) if t[0] == "[" and bare != "H" else None
            weight += (int(hydrogens[1] or 1) if hydrogens else 0) * MASS["H"]
            donors += symbol in ("N", "O") and hydrogens is not None
            if t[0] != "[":
                valence += VALENCE.get(symbol, 0)
                aromatic += t.islower()
        rings = sum(t.isdigit() or t[0] == "%" for t in found) // 2
        bonds = len(atoms) - 1 - found.count(".") + rings
        hydrogens = max(0, valence - 2 * bonds - 2 * found.count("=") - 4 * found.count("#") - aromatic)
        return {"molecular_weight": round(weight + hydrogens * MASS["H"], 3), "hydrogen_bond_donors": float(donors), "hydrogen_bond_acceptors": float(acceptors), "heavy_atoms": float(len(atoms)), "rings": float(rings), "log_p": math.nan}


class Toolkit:
    """The installed chemistry library."""

    approximate = False

    def __init__(self) -> None:
        from rdkit import Chem
        from rdkit.Chem import AllChem, Crippen, Descriptors, Lipinski
        from rdkit.Chem.MolStandardize import rdMolStandardize

        self.chem, self.all, self.crippen, self.descriptors, self.lipinski = Chem, AllChem, Crippen, Descriptors, Lipinski
        self.standard = rdMolStandardize

    def molecule(self, smiles: str):
        try:
            return self.chem.MolFromSmiles((smiles or "").strip()) if (smiles or "").strip() else None
        except Exception:  # the library raises many kinds on odd notations
            return None

    def canonical(self, smiles: str) -> str | None:
        m = self.molecule(smiles)
        return None if m is None else self.chem.MolToSmiles(self.standard.Cleanup(m), isomericSmiles=True)

    def match_key(self, smiles: str) -> str | None:
        m = self.molecule(smiles)
        if m is None:
            return None
        m = self.standard.Normalizer().normalize(self.standard.LargestFragmentChooser().choose(self.standard.Cleanup(m)))
        return self.chem.MolToSmiles(m, isomericSmiles=True)

    def bits(self, smiles: str, size: int = 1024, radius: int = 3) -> list[int] | None:
        m = self.molecule(smiles)
        return None if m is None else list(self.all.GetMorganFingerprintAsBitVect(m, radius, nBits=size))

    def features(self, smiles: str, radius: int = 2) -> list[int] | None:
        m = self.molecule(smiles)
        return None if m is None else sorted(self.all.GetMorganFingerprint(m, radius=radius, useFeatures=True).GetNonzeroElements())

    def fingerprint(self, smiles: str) -> list[int] | None:
        from skfp.fingerprints import PubChemFingerprint

        m = self.molecule(smiles)
        return None if m is None else [int(i) for i in PubChemFingerprint().transform([m])[0].nonzero()[0]]

    def properties(self, smiles: str) -> dict[str, float] | None:
        m = self.molecule(smiles)
        if m is None:
            return None
        d = self.descriptors
        return {"molecular_weight": d.MolWt(m), "log_p": self.crippen.MolLogP(m), "polar_surface": d.TPSA(m), "hydrogen_bond_donors": float(self.lipinski.NumHDonors(m)), "hydrogen_bond_acceptors": float(self.lipinski.NumHAcceptors(m)), "rotatable_bonds": float(self.lipinski.NumRotatableBonds(m))}


def provider() -> Provider:
    """The toolkit where it is installed, else the stand-in."""
    try:
        return Toolkit()
    except ImportError:
        return Lexical()


def column(make: Callable[[], Provider], method: str, kind: str, *arguments) -> Callable[[Column], Column]:
    """A method of a provider as an Arrow function of a column; the provider is made once per worker."""

    @F.pandas_udf(kind)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = getattr(make(), method)
        for s in batches:
            yield s.map(lambda x: own(x, *arguments) if isinstance(x, str) else None)

    return call


def registered(spark, make: Callable[[], Provider] = provider) -> None:
    """The provider's methods as SQL functions: structure_key, structure_canonical, structure_bits, structure_features, structure_fingerprint."""
    for name, method, kind in (("key", "match_key", "string"), ("canonical", "canonical", "string"), ("bits", "bits", "array<int>"), ("features", "features", "array<long>"), ("fingerprint", "fingerprint", "array<int>")):
        spark.udf.register(f"structure_{name}", column(make, method, kind))


def substructure_edges(compounds: DataFrame, make: Callable[[], Provider] = provider, radius: int = 2, key: str = "match_key") -> DataFrame:
    """(compound, sub): the substructures of each compound with a match key; a compound without any has no row."""
    found = column(make, "features", "array<long>", radius)
    return compounds.where(F.coalesce(key, F.lit("")) != "").select(F.col("ID").alias("compound"), F.explode(found(F.col(key))).alias("sub")).select("compound", F.col("sub").cast("string").alias("sub"))


def fingerprint_edges(compounds: DataFrame, make: Callable[[], Provider] = provider) -> tuple[DataFrame, DataFrame]:
    """(edges (node_id, sub_id, bit), rejects (ID, SMILES, reason)) of compounds (ID, SMILES, canonical, node_id).

    Structures go through in batches; one that the provider cannot read is a reject of its own and does not fail its batch.
    """

    def judge(batches):
        own = make()
        for pdf in batches:
            out = []
            for i, smiles, canonical, node in pdf[["ID", "SMILES", "canonical", "node_id"]].itertuples(index=False):
                bits, reason = None, "invalid_smiles"
                if isinstance(canonical, str) and canonical:
                    try:
                        bits, reason = own.fingerprint(canonical), "fingerprint_failed"
                    except Exception:  # a provider may raise on one structure
                        reason = "fingerprint_failed"
                out.append((i, smiles, node, bits, None if bits is not None else reason))
            yield pd.DataFrame(out, columns=["ID", "SMILES", "node_id", "bits", "reason"])

    from ..sources.tables import written

    rows = written(compounds.select("ID", "SMILES", "canonical", "node_id").mapInPandas(judge, "ID string, SMILES string, node_id string, bits array<int>, reason string"), "fingerprints")
    edges = rows.select("node_id", F.explode("bits").alias("bit")).select("node_id", F.format_string("substructure:pubchemfp:%03d", "bit").alias("sub_id"), "bit")
    return edges, rows.where("reason IS NOT NULL").select("ID", "SMILES", "reason")
