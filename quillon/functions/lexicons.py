"""Word lists of the literature domain, as broadcastable tuples."""

from __future__ import annotations

# The word lists that the tokenizer, the quality gate and the pairing rules are defined by.
STOP_WORDS = (
    "the", "a", "an", "for", "of", "to", "in", "on", "with", "and", "or", "is", "are", "we", "our", "by", "from", "as", "at", "this", "that", "these",
    "those", "it", "its", "be", "been", "was", "were", "has", "have", "had", "will", "would", "could", "should", "may", "might", "can", "than",
    "then", "so", "if", "but", "not", "no", "which", "who", "when", "where", "what", "how", "why", "all", "both", "each", "few", "more", "most",
    "other", "some", "such", "only", "own", "same", "very", "just", "also", "into", "through", "during", "before", "after", "above", "below", "up",
    "down", "out", "off", "over", "under", "again", "further", "here", "there", "about", "against", "between", "them", "they", "their", "i", "you",
    "he", "she", "his", "her", "us", "him",
)
MECHANISM_TERMS = (
    "robot", "robotic", "joint", "actuator", "actuation", "transmission", "gearbox", "gear train", "harmonic drive", "planetary", "cycloidal",
    "ball screw", "roller screw", "cable", "tendon", "capstan", "twisted string", "linkage", "cam", "underactuated", "compliant", "compliance",
    "series elastic", "direct drive", "brushless", "motor", "pneumatic", "hydraulic", "artificial muscle", "shape memory", "dielectric elastomer",
    "electroactive polymer", "piezoelectric", "magnetorheological", "origami", "continuum", "soft actuator", "mechanism", "bearing", "friction",
    "spring", "elastic element",
)
EVIDENCE_TERMS = (
    "torque", "force", "efficiency", "backlash", "stiffness", "damping", "bandwidth", "load", "speed", "power", "position", "accuracy", "precision",
    "hysteresis", "fatigue", "lifetime", "durability", "wear", "friction", "prototype", "fabricated", "fabrication", "machined", "printed",
    "experiment", "measured", "measurement", "characterization", "validation", "tested", "test", "performance", "cost", "mass", "weight", "failure",
    "reliability", "repeatability", "compliance",
)
METADATA_TERMS = (
    "conference", "ieee", "international", "proceedings", "symposium", "journal", "transactions", "workshop", "acm", "springer", "elsevier", "wiley",
    "doi", "http", "https", "www", "com", "org", "pdf", "copyright", "license", "volume", "issue", "pages", "author", "authors", "published",
    "accepted", "study", "investigation", "analysis", "research", "approach", "method", "results", "result", "novel", "enhanced", "adaptive",
)
WEAK_BRIDGE_TERMS = (
    "robot", "robotic", "robotics", "design", "control", "system", "application", "model", "method", "mechanism", "performance", "experiment",
    "analysis", "study", "research", "data", "learning", "optimization",
)
METHOD_WORDS = (
    "transformer", "neural", "network", "learning", "optimization", "gradient", "embedding", "attention", "diffusion", "gaussian", "bayesian",
    "graph", "federated", "quantum", "blockchain", "reinforcement", "evolutionary", "meta-learning", "transfer", "cable-driven", "tendon-driven",
    "series-elastic", "compliant", "pneumatic", "hydraulic", "planetary", "harmonic", "actuator", "transmission", "flexure", "morphing", "perovskite",
    "dft", "alloy", "composite", "catalyst", "sintering", "annealing", "deposition", "doping",
)
PROBLEM_WORDS = (
    "robot", "manipulation", "diagnosis", "prediction", "planning", "scheduling", "allocation", "discovery", "generation", "calibration",
    "maintenance", "coordination", "detection", "tracking", "validation", "joint", "torque", "efficiency", "fatigue", "wear", "stiffness", "damping",
    "backlash", "friction",
)
GENERIC_WORDS = (
    "novel", "enhanced", "adaptive", "scalable", "robust", "efficient", "unified", "deep", "progressive", "towards", "based", "approach", "method",
    "framework", "model", "system", "design", "performance", "analysis", "study", "research", "investigation", "experiment", "experimental",
    "simulation", "numerical", "theoretical", "comprehensive", "systematic", "preliminary", "detailed", "general", "proposed", "conference", "ieee",
    "international", "proceedings", "symposium", "journal", "transactions", "workshop", "acm", "springer", "elsevier", "wiley", "robot", "robotics",
    "learning", "machine", "intelligence", "control", "optimization", "algorithm", "data", "result", "evaluation", "assessment", "comparison",
    "application", "implementation", "development", "measurement", "testing", "validation", "micro", "nano", "macro", "large", "small", "high", "low",
    "new", "recent", "advanced", "modern",
)
METRIC_UNITS = ("%", "nm", "mm", "cm", "m", "n\\s*m", "kn", "n", "mn", "μn", "w", "kw", "hz", "rad/s", "deg", "°c", "g", "kg", "j", "pa", "mpa", "ev")


def sql_list(words) -> str:
    """A list literal for SQL."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
