"""Categories and short names used for the literature tables."""

from __future__ import annotations

# Model categories and their members.
MODEL_CATEGORIES = {
    "Tree-based": [
        "XGBoost", "LightGBM", "RF", "M5-Prime", "CatBoost", "AdaBoost", "SGBRT", "QRF", "Gradient Boosting Regression",
        "Decision Tree", "BART",
    ],
    "Neural Network": [
        "MLP", "ANN", "Feed forward NN", "CNN", "RNN", "LSTM", "GRU", "DBN", "RBFNN", "Extreme Learning Machine (ELM)",
        "NN with Quantile Loss", "CVAE", "Wavelet", "adaptive neuro-fuzzy interference system (ANFIN)",
    ],
    "Linear / GLM": [
        "Linear model", "Piece-wise Linear Regression", "Linear hinges model", "GLM", "Ordinary Least Squares", "LASSO",
    ],
    "Kernel / Nonparametric": [
        "SVR", "AMK", "Conditional Kernel Density Estimation", "Radial Basis Function (RBF)", "Fuzzy Clustering", "CCFL",
    ],
    "Bayesian": ["Gaussian Process", "Bayesian hierarchical inference", "MLE", "MCS", "Relevance Vector Machine"],
    "Statistical": [
        "Logarithmic Regression", "Cubic model", "Quadratic model", "Exponential model", "EWMA", "GWMA",
        "Autoregressive Model (AR)", "Weibull CDF model", "Rayleigh Wind Distribution Model", "Sum of Sines",
        "Fourier Series Interpolation", "Mode approach", "Logistic Function", "Modified hyperbolic tangent function",
        "Gaussian Model", "Gaussian wake model", "Ratio Model", "Polynomial regression", "Polynomial model",
        "Piece-wise Polynomial Regression", "Piece-wise Exponential Regression", "SHMSRM", "SSANOVA",
        "piecewise cubic Hermite interpolating polynomial", "General model", "Power Surface", "BVK", "RSM",
    ],
    "Physics-informed": [
        "Jensen's Wake Model", "Shihara-Qian wake model", "IEC Standard", "Power-coefficient based model", "PARK model",
        "LES with Smagorinsky-Lill model", "SDE",
    ],
}

# Feature categories and their members.
FEATURE_CATEGORIES = {
    "Wind Speed": ["Wind Speed"],
    "Inflow Direction": ["Wind Direction", "inflow angle"],
    "Yaw Control": ["Yaw Misalignment", "yaw angle", "Nacelle Orientation", "Tilt Yaw Control"],
    "Blade Pitch Control": ["Blade Pitch Angle", "Blade Pitch Travelled Distance", "Blade Piston Travelled Distance"],
    "Blade Pitch Hydraulics": ["Blade Pitch Manifold Oil Pressure", "Blade Pitch Cylinder Pressure"],
    "Mechanical Loads": [
        "Blade Load", "Blade Loads Bearing Tilt Moment", "Blade Loads Bearing Yaw Moment", "Tilt Moment", "Yaw Moment",
    ],
    "Generator Speed": ["Generator speed"],
    "Electrical Output": ["Voltage", "Current"],
    "Tower Vibrations": ["Tower Vibrations"],
    "Tower Acceleration": ["Tower Acceleration"],
    "Aerodynamic Performance": ["Axial Induction Factor", "power density", "aerodynamic efficiency"],
    "Theoretical Power Model": ["Theoretical_Power_Curve"],
    "Normalized Power": ["Normalized Wind Power"],
    "Operating Thresholds": ["cut-in speed", "cut-out speed"],
    "Site Conditions": ["Power of nearby turbines", "wake effect", "Terrain Gradient"],
    "Temporal Feature": ["Datetime"],
}

# Short names for charts.
SHORT_NAMES = {
    "feature": {
        "Wind Direction": "Wind Dir.",
        "Turbulence Intensity": "TI",
        "Ambient Temperature": "Amb. Temp.",
        "Yaw Misalignment": "Yaw Error",
        "Blade Pitch Angle": "Pitch Angle",
        "Sunshine Hours": "Sunshine Hrs",
    },
    "model": {
        "IEC Standard": "IEC",
        "Piece-wise Linear Regression": "PWLR",
        "Piece-wise Polynomial Regression": "PolyReg",
        "Polynomial regression": "PolyReg",
        "Modified hyperbolic tangent function": "MHTan",
        "Gaussian Process": "GP",
        "Logistic Function": "Log. Func.",
        "Feed forward NN": "NN",
    },
    "evaluation": {"R^2": "$R^2$"},
}

# The item every paper uses unless it says otherwise.
IMPLIED_FEATURE = {"item": "Wind Speed", "only": "Wind Speed Only", "without": "No Wind Speed"}


def item_to_category(categories: dict[str, list[str]]) -> dict[str, str]:
    return {item: category for category, items in categories.items() for item in items}
